"""The pipeline's stages on a small table: what they drop, and that clean documents stay."""

import random
import re

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    passage, rows, labels = text(70), [], []
    for i in range(200):
        rows.append((i, text(60), "en", "s", 1))
    for i in range(200, 240):
        rows.append((i, text(30) + " nasty rotten vile " + text(10), "en", "s", 1))
    rows += [(240 + i, rows[i][1].replace(" ", "\n", 3), "en", "s", 1) for i in range(5)]
    for i in range(5):
        w = rows[10 + i][1].split()
        w[-1] = "changed"
        rows.append((250 + i, " ".join(w), "en", "s", 1))
    rows += [(260 + i, f"{text(20)} {passage} {text(20)}", "en", "s", 1) for i in range(4)] + [(270, passage, "en", "s", 1), (271, None, None, None, None)]
    labels = [(i, 1, int(200 <= i < 240)) for i in range(0, 240, 2)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs, ids, texts = spark.read.parquet(f"{path}/documents.parquet"), {r[0] for r in rows}, {r[0]: r[1] for r in rows}
    columns = docs.columns
    gone = {"toxicity": set(range(200, 240)), "exact dedup": set(range(240, 245)), "near dedup": set(range(250, 255)), "substring dedup": {270}}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        ids -= gone[name]
        kept = {r.doc_id: r for r in docs.collect()}
        assert set(kept) == ids, name
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    assert passage in kept[260].text and all(passage not in kept[i].text and len(kept[i].text.split()) == 40 for i in (261, 262, 263))
    assert all(kept[i].text == texts[i] for i in ids if i not in (261, 262, 263))
    packed = pipeline.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.collect()} == ids
    assert sorted(map(tuple, pipeline.run(spark, path).collect())) == sorted(map(tuple, packed.collect()))


def test_stages_decide_on_rows(spark, folder):
    path, rows, passage = folder
    rng = random.Random(5)
    text = lambda n: " ".join(f"u{rng.randrange(3000)}" for _ in range(n))
    nasty, clean, a, b, c, near = text(30) + " nasty rotten vile", text(40), text(40), text(20), text(20), text(60)
    texts = [(None, nasty), (300, nasty + " rotten"), (300, clean), (None, a), (None, a), (2, a), (301, f"{passage} {b}"), (301, f"{passage} {c}"), (302, near), (302, text(60)), (None, near + " changed"), (303, near + " other")]
    docs = spark.createDataFrame([*rows, *((i, x, "en", "s", 1) for i, x in texts)], spark.read.parquet(f"{path}/documents.parquet").schema)
    got = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        kept = [tuple(r) for r in docs.collect()]
        got.append([(r[0], r[1]) for r in kept])
        docs = spark.createDataFrame(kept, docs.schema)
    toxic, exact, close, cut = got
    assert not any("nasty" in (x or "") for _, x in toxic) and (300, clean) in toxic and len(toxic) == len(rows) - 40 + len(texts) - 2
    assert [i for i, x in exact if x == a] == [2] and len(toxic) - len(exact) == 5 + 2
    assert (302, near) in close and not {(None, near + " changed"), (303, near + " other")} & {*close} and sum(i == 302 for i, _ in close) == 2
    assert sorted(x for i, x in cut if i == 301) == sorted([b, c]) and len({*cut}) == len(cut)


def test_stage_names():
    assert len(pipeline.STAGES) == 5 and all(re.fullmatch(r"[a-z ]+", n) for n, _ in pipeline.STAGES)
