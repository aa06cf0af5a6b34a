"""Listing a tar by ranges against reading it from one end to the other."""

import io
import random
import tarfile

import pytest

from threadlake.sources.tars import read_tar_members


def add(tar, name, data):
    m = tarfile.TarInfo(name)
    m.size = len(data)
    tar.addfile(m, io.BytesIO(data))


def packed(*members, end=True):
    out = io.BytesIO()
    tar = tarfile.open(fileobj=out, mode="w")
    for name, data in members:
        add(tar, name, data)
    if end:
        tar.close()
    return out.getvalue()


def listed(spark, path, range_bytes):
    paths = spark.createDataFrame([("a", str(path))], "archive string, path string")
    return sorted(map(tuple, read_tar_members(spark, paths, range_bytes).collect()))


def whole(path):
    with tarfile.open(path) as tar:
        return sorted(("a", path.name, m.name, m.offset_data, m.size) for m in tar if m.isreg())


@pytest.fixture(scope="module")
def odd_tar(tmp_path_factory):
    """Tars within tars, with and without an end, long names, folders, empty members, and one over many ranges."""
    rng = random.Random(4)
    path = tmp_path_factory.mktemp("tars") / "odd.tar"
    inner = packed(*((f"inner/{i}", rng.randbytes(rng.randrange(1500))) for i in range(12)))
    deep = packed(("middle", inner), ("more", b"y" * 700))
    lying = packed(("lie", b"z" * 600), end=False)[:512] + b"q" * 5000
    huge = tarfile.TarInfo("beyond")
    huge.size = 10**9
    with tarfile.open(path, "w") as tar:
        for i in range(40):
            add(tar, f"{i}/file", rng.randbytes(rng.randrange(3000)))
            if i % 5 == 0:
                add(tar, f"{i}/inner.tar", rng.choice([inner, deep, lying, huge.tobuf() + b"x" * 4000]))
            if i % 7 == 0:
                add(tar, f"{i}/" + "long" * 60, b"l" * 100)
                folder = tarfile.TarInfo(f"{i}/folder")
                folder.type = tarfile.DIRTYPE
                tar.addfile(folder)
                add(tar, f"{i}/empty", b"")
        add(tar, "big", bytes(60_000))
        add(tar, "last", b"x")
    return path


@pytest.mark.parametrize("range_bytes", [1024, 10_240, 1 << 30])
def test_ranges_meet(spark, odd_tar, range_bytes):
    want = whole(odd_tar)
    assert len(want) > 55 and not any("inner/" in name for _, _, name, *_ in want)
    assert listed(spark, odd_tar, range_bytes) == want


def test_ends_and_other_files(spark, tmp_path):
    """What comes after the end is not listed; a tar without an end is; a compressed one is read whole; repeated paths give rows each."""
    appended = tmp_path / "appended.tar"
    appended.write_bytes(packed(("a", b"1" * 2000)) + packed(("b", b"2" * 2000)))
    assert [r[2] for r in listed(spark, appended, 1024)] == ["a"]
    cut = tmp_path / "cut.tar"
    cut.write_bytes(packed(("a", b"1" * 2000), ("b", b"2" * 10), end=False))
    assert [r[2] for r in listed(spark, cut, 512)] == ["a", "b"]
    short = tmp_path / "short.tar"
    short.write_bytes(packed(("a", b"1" * 2000), ("b", b"2" * 3000))[:4000])
    assert [r[2] for r in listed(spark, short, 512)] == ["a", "b"]
    small = tmp_path / "small.tgz"
    with tarfile.open(small, "w:gz") as tar:
        add(tar, "a", b"1" * 2000)
    assert listed(spark, small, 512) == whole(small)
    none = tmp_path / "none.tar"
    none.write_bytes(packed())
    assert listed(spark, none, 512) == []
    twice = spark.createDataFrame([("a", str(cut))] * 2, "archive string, path string")
    assert read_tar_members(spark, twice, 1024).count() == 4
    assert read_tar_members(spark, twice.limit(0), 1024).count() == 0
    text = tmp_path / "text.tar"
    text.write_bytes(b"no tar at all")
    with pytest.raises(Exception, match="ReadError"):
        listed(spark, text, 512)
