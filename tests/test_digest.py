import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factweave.sources.digest import EMPTY, FAN, file_digests, source_digest


@pytest.fixture
def small_splits(spark):
    """Splits of a few thousand bytes, so that each file has many."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def noise(seed: int, n: int) -> bytes:
    r = random.Random(seed)
    return b"".join(r.choice([b"a,b,1\n", b"\r\n", b"\n", b"\xff\xfe\x00\n", "é三\n".encode(), b"x" * r.randint(0, 300) + b"\n", b"\r"]) for _ in range(n))


FILES = {
    "plain": noise(1, 2000), "no_end": noise(2, 2000) + b"last", "mark": b"\xef\xbb\xbf" + noise(3, 500), "mark_no_end": b"\xef\xbb\xbf" + noise(4, 500) + b"last",
    "one_line": b"x" * 20000, "line_ends": b"\n" * 9000, "one_byte": b"a", "one_end": b"\n", "mark_only_line": b"\xef\xbb\xbf\n", "carriage": b"a\r\nb\r\n" * 2000, "long_last": noise(5, 300) + b"y" * 30000,
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_single_file(small_splits, tmp_path, name):
    (tmp_path / "cells.csv").write_bytes(FILES[name])
    assert source_digest(small_splits, str(tmp_path / "cells.csv")) == hashlib.sha256(FILES[name]).hexdigest()


def tree(data: bytes, piece: int) -> str:
    """The same tree from a file's bytes: a line belongs to the piece in which it starts (a mark isn't counted)."""
    body, mark = (data[3:], data[:3]) if data.startswith(b"\xef\xbb\xbf") else (data, b"")
    pieces, at = {}, 0
    for line in body.split(b"\n")[: -1 if body.endswith(b"\n") else None]:
        pieces.setdefault(at // piece, []).append(line + b"\n")
        at += len(line) + 1
    blobs = {p: b"".join(lines) for p, lines in pieces.items()}
    blobs[0] = mark + blobs[0]
    if not body.endswith(b"\n"):
        last = max(blobs)
        blobs[last] = blobs[last][:-1]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    nodes = {}
    for p in sorted(blobs):
        nodes.setdefault(p // FAN, []).append(sha(blobs[p]))
    return sha("".join(sha("".join(nodes[n]).encode()) for n in sorted(nodes)).encode())


def test_trees_whatever_the_splits(small_splits, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), tree(data, 1000)) for name, data in FILES.items()}
    for size in ("4096", "700", "10000000"):
        small_splits.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = file_digests(small_splits, str(tmp_path), 1000).withColumn("name", F.substring_index("file", "/", -1)).collect()
        assert {r["name"]: (r["n_bytes"], r["sha256"]) for r in rows} == want


def test_folders(small_splits, tmp_path):
    digest = lambda: source_digest(small_splits, str(tmp_path), 1000)
    (tmp_path / "empty").write_bytes(b"")
    assert digest() == source_digest(small_splits, str(tmp_path / "empty")) == EMPTY
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(FILES["plain"])
    (tmp_path / "b").write_bytes(FILES["no_end"])
    first = digest()
    assert first == digest() and len(first) == 64
    (tmp_path / "b").write_bytes(FILES["no_end"] + b"\n")
    changed = digest()
    (tmp_path / "b").rename(tmp_path / "c")
    assert first != changed == digest()
    (tmp_path / "d").write_bytes(FILES["plain"])
    assert digest() not in (first, changed)
