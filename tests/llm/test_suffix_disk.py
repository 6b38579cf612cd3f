"""Disk of the suffix index: shuffles and seeds go when they have been read, and a scan says only what is new."""

import time

import numpy as np

from factweave.llm import suffix_dedup
from factweave.llm.common import SHUFFLE_CLEANUP


def _arrays(texts, shards):
    whole = np.frombuffer(b"".join(t.ljust(24, b".") for t in texts), np.uint8)
    return suffix_dedup._prefixes(whole, np.arange(0, len(whole), 24)), np.array(shards, np.uint32), np.zeros(len(texts), np.uint32)


def _told(table):
    return {(s, k) for s, body in zip(table.column("shard").to_pylist(), table.column("body").to_pylist()) for k in np.frombuffer(body, np.uint64).tolist()}


def test_scans_tell_no_pair_again():
    old = _arrays([b"twice", b"twice", b"thrice", b"thrice", b"alone", b"met"], [1, 2, 1, 2, 1, 2])
    new = _arrays([b"thrice", b"met", b"fresh", b"fresh", b"single"], [3, 3, 3, 4, 4])
    keys = dict(zip(["twice", "thrice", "met", "fresh"], suffix_dedup._prefix_keys(_arrays([b"twice", b"thrice", b"met", b"fresh"], [0] * 4)[0]).tolist()))
    found = _told(suffix_dedup._seeds(suffix_dedup._both(new, old), len(new[1])))
    assert found == {(s, keys[k]) for k, owners in (("thrice", (1, 2, 3)), ("met", (2, 3)), ("fresh", (3, 4))) for s in owners}
    before = _told(suffix_dedup._seeds(old))
    assert before == {(s, keys[k]) for k in ("twice", "thrice") for s in (1, 2)}
    assert found | before == _told(suffix_dedup._seeds(suffix_dedup._both(new, old)))
    nothing = suffix_dedup._level_arrays(suffix_dedup._LEVEL.empty_table())
    assert suffix_dedup._seeds(suffix_dedup._both(nothing, old), 0).num_rows == suffix_dedup._seeds(suffix_dedup._both(nothing, nothing), 0).num_rows == 0


def test_no_shuffle_nor_seed_is_left(spark, monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(i, f"{text[i:]} {i} {text}") for i in range(40)], "doc_id long, text string")
    folders, drop = [], suffix_dedup.LogIndex.drop_seeds
    monkeypatch.setattr(suffix_dedup.LogIndex, "drop_seeds", lambda self: (folders.append(self.seeds), drop(self))[1])

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before, conf = shuffled(), spark.conf.get(SHUFFLE_CLEANUP, None)
    result = suffix_dedup.repeated_spans(docs, batches=3, shard_bytes=3000)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == conf
    path = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert result.count() == 40 and result.where("n_removed > 0").count() == 39
