"""Runs of lines against all runs of small texts, and long texts of marks."""

import random
import re
import time

from threadlake.llm import license_scan

T = 0.8


def grams(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return {(a, b) for a, b in zip(words, words[1:])}


def brute(text, templates):
    """(line_no, license, template_no, dice) of lines, whole texts and the best runs, trying every run of filled lines."""
    lines, out = text.split("\n"), []
    wanted = [(name, i, grams(t)) for name, ts in templates.items() for i, t in enumerate(ts)]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a else 0
    units = list(enumerate(lines)) + ([(-1, " ".join(lines))] if len(lines) > 1 else [])
    out += [(no, name, i, dice(grams(u), b)) for no, u in units for name, i, b in wanted if dice(grams(u), b) >= T]
    filled = [(no, x) for no, x in enumerate(lines) if re.search("[a-z0-9]", x.lower())]
    for name, i, b in wanted:
        runs = [(dice(g, b), p, q) for p in range(len(filled)) for q in range(p, len(filled)) if dice(g := grams(" ".join(x for _, x in filled[p : q + 1])), b) >= T]
        for d, p, q in runs:
            beaten = any(o <= q and p <= r and (o == r or (-e, r - o, o) < (-d, q - p, p)) for e, o, r in runs)
            if p < q and (p > 0 or q < len(filled) - 1) and not beaten:
                out.append((filled[p][0], name, i, d))
    return sorted(out)


def test_all_runs_of_small_texts(spark):
    """Templates cut into lines at random, with changed words, other lines around, empty lines, and two copies in a text."""
    rng = random.Random(5)
    templates = {"A": (" ".join(f"a{i}" for i in range(24)), "short one of six words here"), "B": (" ".join(f"b{i}" for i in range(40)),)}
    rows = []
    for n in range(150):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [rng.choice(["other words of a text", "more", "", "a1 a2 by chance"]) for _ in range(rng.randrange(3))]
            words = rng.choice([t for ts in templates.values() for t in ts]).split()
            words = [w if rng.random() > 0.06 else "changed" for w in words]
            while words:
                cut = rng.randrange(1, 16)
                lines.append(" ".join(words[:cut]))
                words = words[cut:]
                if rng.random() < 0.1:
                    lines.append("")
        rows.append((n, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.license, r.template_no, round(r.dice, 9)) for r in license_scan.scan_licenses(docs, templates).collect())
    want = sorted((n, no, name, i, round(d, 9)) for n, text in rows for no, name, i, d in brute(text, templates))
    assert len(want) > 150 and got == want


def test_work_grows_with_the_marks(spark):
    """Eight times the marked lines take about eight times as long, not the square; each notice is found."""
    template = " ".join(f"a{i}" for i in range(24))
    notice = "\n".join([" ".join(template.split()[i : i + 6]) for i in range(0, 24, 6)] + ["between the notices"])
    took = []
    for n in (250, 2000):
        docs = spark.createDataFrame([(1, "\n".join([notice] * n))], "doc_id long, text string")
        start = time.time()
        found = license_scan.scan_licenses(docs, {"A": (template,)}).collect()
        took.append(time.time() - start)
        assert sorted(r.line_no for r in found) == [-1] + [5 * i for i in range(n)]
    assert took[1] < 16 * took[0] + 5
