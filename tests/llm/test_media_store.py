import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from strandline.llm import flac, media


def test_query_digests_the_streams_that_it_stored(spark, monkeypatch):
    paths, store = [], media.store
    monkeypatch.setattr(media, "store", lambda *a, **b: paths.append(store(*a, **b)) or paths[-1])
    made = media.op6_flac_media(spark, "/root/testdata/sf0.001")
    assert len(paths) == 1
    read = made.inputFiles()
    assert read and all(re.sub("^file:/*", "/", f).startswith(re.sub("^file:/*", "/", paths[0])) for f in read)
    stored = {r["doc_id"]: r["media"] for r in spark.read.parquet(paths[0]).collect()}
    got = {r["doc_id"]: r for r in made.collect()}
    assert stored and got.keys() == stored.keys()
    assert all(r["media_bytes"] == len(stored[k]) and r["media_sha256"] == hashlib.sha256(stored[k]).hexdigest() for k, r in got.items())


def test_companding_ranks_bytes_and_is_undone(spark):
    texts = ["aaab", "ab é", None, "", "x" * 3000, bytes(range(128)).decode() * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = Counter(b for t in texts for b in media.payload(t)[0])
    ranked = sorted(range(256), key=lambda b: (-counts[b], b))
    table = media.companding(docs)
    assert sorted(table) == list(range(256)) and [table[b] - 128 for b in ranked[:5]] == [0, -1, 1, -2, 2]
    stored = spark.read.parquet(media.store(docs))
    assert {bytes(r["written_as"]) for r in stored.collect()} == {table}
    plain = {r["doc_id"]: r for r in media.digest(media.encode_media(docs)).collect()}
    for r in media.digest(stored).collect():
        payload, n = media.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_sha256"]) == (n, hashlib.sha256(payload).hexdigest())
        assert r["sample_offsets"] == ",".join(str(k) for k in range(0, len(payload), flac.BLOCK))
        assert (r["feature"], r["tail_crc32"]) == (plain[r["doc_id"]]["feature"], zlib.crc32(payload[-64:]))
    for r in stored.collect():
        assert flac.decode([r["media"]])[0][0].tolist() == [table[b] - 128 for b in media.payload(texts[r["doc_id"]])[0]]
    blocks = media.pcm_blocks(stored).where("doc_id = 4").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip(b"\0") == texts[4].encode()


def test_rice_parameters_are_near_the_best():
    rng = np.random.default_rng(3)
    for mean in (0, 1, 3, 30, 300):
        grouped = rng.geometric(1 / (mean + 1), (20, 4, 64)).astype(np.int32) - 1
        cost = np.stack([(grouped >> k).sum(axis=2) + 64 * (k + 1) for k in range(12)])
        own = np.take_along_axis(cost, flac._parameters(grouped)[None], axis=0)[0]
        assert (own <= cost.min(axis=0) * 1.02).all()
