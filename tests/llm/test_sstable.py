import random
import zlib

import numpy as np

from quillgraph.llm import sstable
from quillgraph.llm.sstable import FileReader, encode_documents, id_of, key_of, write_tables
from quillgraph.llm.tokens import encoder

SCHEMA = "doc_id long, text string, start long, path string"


def ids_of(text):
    return np.frombuffer(encoder("word_bpe_49k.json").encode([text])[0], dtype="<u4").tolist() + [1]


def test_keys_sort_as_ids():
    ids = [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    assert [id_of(key_of(i)) for i in ids] == ids and sorted(map(key_of, ids)) == [key_of(i) for i in ids]


def test_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    rnd = random.Random(1)
    texts = {i * 3 - 50: " ".join(rnd.choice(["Red", "fox", "jumps!", "é"]) for _ in range(rnd.randrange(40))) for i in range(200)}
    texts |= {9000: None, 9001: "", 9002: "long " * 30_000}
    df = spark.createDataFrame([(k, v, 0, "p") for k, v in texts.items()], SCHEMA)
    manifest = write_tables(df, f"file://{tmp_path}/t", partitions=3, file_bytes=4_000)
    files = manifest.orderBy("part", "file").collect()
    assert sum(f.entries for f in files) == len(texts) and len(files) > 3
    readers = [FileReader(f.path) for f in files]
    assert [id_of(k) for r in readers for k, _ in r.scan()] == sorted(texts)
    for k in [-50, -47, 100, 9000, 9002]:
        hits = [x for r in readers for x in r.get(k)]
        assert len(hits) == 1 and hits[0].tolist() == ids_of(texts[k] or "")
    assert all(r.get(7777) == [] for r in readers)
    out = sorted(sstable.read_tables(manifest).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in out:
        ids = ids_of(texts[r.doc_id] or "")
        assert (r.start, r.n_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_repeats_nulls_and_empty(spark):
    out = encode_documents(spark.createDataFrame([(1, "a", 0, "")] * 3 + [(None, "b", 0, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.start) for r in out) == [(0, 0), (1, 2), (1, 4), (1, 6)]
    assert encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
