"""Sharding, WARC, embeddings, components, and the pipeline."""

import gzip
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import by_id
from tidemark.llm import embedding_dedup, sharding, warc
from tidemark.llm._common import fresh, table
from tidemark.llm.components import connected_components


# ---- sharding

def test_differencing_on_known_numbers():
    where, sums = sharding.difference([[8], [7], [6], [5], [4]], 2)
    assert sums == [16, 14] and sorted(np.bincount(where[:, 0], [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    assert sharding.difference([], 3)[1] == [0, 0, 0]


@pytest.mark.parametrize("blocks", [0, 7])
@pytest.mark.parametrize("giant", [0, 100_000, 900_000])
def test_differencing_against_the_greedy_rule(blocks, giant):
    rng = random.Random(3)
    sizes = [int(rng.lognormvariate(6, 1.2)) + 1 for _ in range(2100)] + [giant] * (giant > 0)
    items = sizes
    if blocks:  # bundles of the small ones, as the operator makes them
        limit = sum(sizes) // (16 * 100)
        small = [x for x in sizes if x <= limit]
        items = [x for x in sizes if x > limit] + [n for i in range(blocks) for n in sharding.difference([[x] for x in sorted(small[i::blocks], reverse=True)], 16)[1]]
    sums = sharding.difference([[x] for x in sorted(items, reverse=True)], 16)[1]
    greedy = [0] * 16
    for x in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += x
    assert sum(sums) == sum(sizes) and max(sums) <= 1.01 * max(greedy)


def test_differencing_against_a_plain_version():
    """All partial partitions as lists, the two of the largest spread combined, over and over."""
    rng = random.Random(12)
    for _ in range(60):
        k, sizes = rng.choice([2, 3, 5]), sorted((rng.randint(1, 10**6) for _ in range(rng.randint(1, 14))), reverse=True)
        partials = [[s] + [0] * (k - 1) for s in sizes]
        while len(partials) > 1:
            partials.sort(key=lambda x: max(x) - min(x), reverse=True)
            a, b = sorted(partials.pop(0), reverse=True), sorted(partials.pop(0))
            partials.append([x + y for x, y in zip(a, b)])
        where, sums = sharding.difference([[s] for s in sizes], k)
        loads = [0] * k
        for s, j in zip(sizes, where[:, 0].tolist()):
            loads[j] += s
        assert sorted(loads) == sorted(sums) == sorted(partials[0])


def test_shards_by_three_levels(spark):
    """Blocks of few groups, so that bundles are bundled again; sizes stay nearly equal."""
    rng = random.Random(5)
    texts = ["x" * rng.randint(1, 400) + str(i) for i in range(2000)] + ["same"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.balanced_shards(docs, 3, block_groups=12, least_blocks=20).collect()
    loads = [sum(r["size"] for r in out if r.shard == j) for j in range(3)]
    assert len(out) == len(texts) and max(loads) - min(loads) <= 450 and len({r.shard for r in out if texts[r.doc_id] == "same"}) == 1
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))


def test_shards(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    got = sharding.op7_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) and all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    slots, shard_of, loads = {}, {}, [0] * 16
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert max(loads) - min(loads) <= max(len(t.encode()) for t in texts.values())
    out = sharding.balanced_shards(odd, 3, block_groups=2).collect()
    assert len(out) == odd.count() and len({r.shard for r in out if r.doc_id == 5}) == 1
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out}[1] == (1, 0)
    assert sharding.balanced_shards(none).count() == 0


# ---- WARC

def test_archive_is_read_by_gzip_and_by_us():
    pages = [(1, "http://a/ä\r\n", b"x" * 300, None), (2, None, b"", None), (3, "http://b", b"y\r\n\r\nz", 1)]
    raw = b"".join(warc.gzip_member(warc.record_bytes(p, u, b, hashlib.sha256(b).hexdigest(), f)) for p, u, b, f in pages)
    assert gzip.decompress(raw).count(b"WARC/1.1") == 3
    got = list(warc.read_archive(io.BytesIO(raw)))
    assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"], r["payload"], r["digest_ok"]) for r in got] == [(1, "response", 300, None, b"x" * 300, True), (2, "response", 0, None, b"", True), (3, "revisit", 6, 1, None, True)]
    assert got[0]["position"] == 0 and raw[got[1]["position"] :][:2] == b"\x1f\x8b"
    tiny = warc.Members(io.BytesIO(raw), chunk=7)
    assert [b"".join(c) for _, c in tiny] == [gzip.decompress(warc.gzip_member(warc.record_bytes(p, u, b, hashlib.sha256(b).hexdigest(), f))) for p, u, b, f in pages]


def test_broken_archives():
    data = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(io.BytesIO(warc.gzip_member(data)[:-9])))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.read_archive(io.BytesIO(warc.gzip_member(data[:-6]))))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.read_archive(io.BytesIO(warc.gzip_member(b"HTTP/1.1\r\nA: b\r\n\r\n"))))
    wrong = next(iter(warc.read_archive(io.BytesIO(warc.gzip_member(data.replace(b"payload\r\n", b"paYload\r\n"))))))
    assert not wrong["digest_ok"]


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_round_trip(spark, hot_rows):
    big, rows = "<p>" + "é" * 2000, []
    rows = [(5, "u5", big, 1), (3, "u3", big, 1), (9, None, big, 1), (4, "u", "tiny", 1), (2, "u", "tiny", 1), (7, "u", None, 1), (8, "u", "", 1), (None, "u", big, 1), (1, "u", "x" * 99, 1), (6, "u", "x" * 99, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = fresh(spark, "warc-test")
    files = warc.write_archives(pages, folder, roll_bytes=500, hot_rows=hot_rows)
    assert files.count() > 1
    got = warc.read_archives(files, folder).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    at = {r.page_id: r for r in got}
    assert at[3].record_type == "response" and at[3].payload == big.encode() and (at[5].refers_to, at[9].refers_to, at[None].refers_to) == (3, 3, 3) and at[5].record_type == "revisit" and at[5].payload_bytes == len(big.encode())
    assert all(at[k].record_type == "response" for k in (1, 2, 4, 6, 7, 8)) and at[7].payload_bytes == 0
    empty = warc.write_archives(pages.where("false"), fresh(spark, "warc-test"))
    assert warc.read_archives(empty, folder).count() == 0


# ---- embeddings

def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    turned, codes, factors = embedding_dedup.code_of(v, rotation)
    error = (turned @ codes.T) / factors[None, :] - v @ v.T
    assert abs(error.mean()) < 0.01
    sigma = np.sqrt((1 - factors**2) / factors**2 / 63)
    assert (np.abs(error) <= 6 * sigma[None, :] + 1e-4).all()


def brute_links(rows, threshold=0.95):
    good = {}
    for i, (key, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64) / max(map(abs, v))
            good[i] = x / np.linalg.norm(x)
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= threshold} if i in good else set() for i in range(len(rows))}
    label = {i: rows[i][0] for i in links}
    for _ in rows:
        for i, js in links.items():
            for j in js:
                label[i] = label[j] = min(label[i], label[j])
    return sorted((rows[i][0], len(links[i]), label[i], rows[i][0] == label[i]) for i in links)


def test_stored_codes_give_unbiased_bounded_estimates():
    rng = np.random.default_rng(1)
    for dim in (2, 3, 64, 129):
        v = embedding_dedup._unit(rng.standard_normal((400, dim)) * rng.choice([1e-200, 1.0, 1e200], (400, 1)))
        raw, n = embedding_dedup.packed_codes(v), len(embedding_dedup.code_rotations(dim))
        assert raw.shape[1] == n * (-(-dim // 8) + 4) + -(-dim // 2) + 8
        x, q, spread, step = codes = embedding_dedup.unpacked_codes(raw, dim)
        if dim >= 64:
            error = (q @ x.T - v @ v.T)[~np.eye(400, dtype=bool)]
            assert abs(error.mean()) < 0.003 and 0.5 < error.std() / np.sqrt(spread.mean() + (step**2).mean() / 12) < 1.1
        near = v + rng.standard_normal(v.shape) * 0.01 / math.sqrt(dim)
        others = embedding_dedup.unpacked_codes(embedding_dedup.packed_codes(embedding_dedup._unit(near)), dim)
        kept = np.concatenate([can for _, can in embedding_dedup.undecided(codes, others, 0.95, 6.0)])
        assert kept[v @ embedding_dedup._unit(near).T >= 0.95].all()
        if dim >= 64:
            assert kept.mean() < 0.004


def test_links_at_the_threshold_and_of_other_lengths(spark):
    """Planted pairs at a cosine of 0.95 to 0.952 (and just below) among others, and short vectors."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(600):
        a, b = rng.standard_normal(32), rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + (0.002 if k % 3 else -0.002) * float(rng.random())
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (3 * (c * a + math.sqrt(1 - c * c) * b)).tolist())]
    rows += [(5000, [1.0, 2.0]), (5001, [1.0, 2.0]), (5002, [2.0, 4.1]), (5003, [1.0]), (5004, [7.0]), (5005, [-7.0]), (5006, [1e200, 2e200]), (5007, [1e-200, 2e-200])]
    ids = np.random.default_rng(2).permutation(len(rows)).tolist()
    rows = [(ids[i], v) for i, (_, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    want = brute_links(rows)
    assert got == want and sum(n > 0 for _, n, _, _ in want) > 800


@pytest.mark.parametrize("block", [4096, 5])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(8):
        centre = rng.standard_normal(16)
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in (centre + rng.standard_normal(16) * 0.15).astype(np.float32)]))
    rows += [(len(rows) + k, rows[3][1]) for k in range(4)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, [x * 2 for x in rows[0][1]]), (205, []), (206, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, block=block, miss=1e-9).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_links(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id IN (200, 201)")).where("kept AND n_links = 0").count() == 2


@pytest.mark.parametrize("block", [4096, 5])
def test_chains_with_shuffled_ids_stay_whole(spark, block):
    rows, ids = [], np.random.default_rng(11).permutation(240).tolist()
    for g in range(40):  # only neighbours of a chain reach the threshold: cos 15 degrees is 0.966, cos 30 is 0.866
        for k in range(6):
            v = [0.0] * 80
            v[2 * g], v[2 * g + 1] = math.cos(math.radians(15 * k)), math.sin(math.radians(15 * k))
            rows.append((ids[len(rows)], v))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df, block=block, miss=1e-9).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_links(rows)


def test_smallest_reachable_nodes():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 20), (300, 290), (1000, 1500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            before = list(want)
            for i, j in zip(a.tolist(), b.tolist()):
                want[i] = want[j] = min(want[i], want[j])
            if want == before:
                break
        assert embedding_dedup._roots(a, b, n).tolist() == want


# ---- components

def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)] + [(300, 299), (299, 300)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {200: 200, 201: 200, 202: 200, 299: 299, 300: 299}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- pipeline

def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline as P
    from tidemark.llm import quality, secrets, sentencepiece
    from tidemark.llm import text as T

    docs = table(spark, sf_dir, "documents")
    rows, labels = {r.doc_id: r for r in docs.collect()}, quality.graded(table(spark, sf_dir, "labels"))
    model = quality.train(docs, labels)
    keep = [d for d, p in zip(rows, model.tails(quality.features([r.text.encode() for r in rows.values()]))) if p[1] >= 0.5]
    stages = dict(P.STAGES)
    one = stages["quality"](spark, docs, sf_dir)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(keep)
    sets, label = {d: T.shingles(rows[d].text) for d in keep}, {d: d for d in keep}
    ids, changed = sorted(sets), True
    links = [(i, j) for i in ids for j in ids if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    two = stages["near_duplicates"](spark, one, sf_dir)
    left = [d for d in ids if label[d] == d]
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == left
    items = [T.shingles(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    three = stages["decontamination"](spark, two, sf_dir)
    left = [d for d in left if not any(q and len(q & sets[d]) >= 0.8 * len(q) for q in items)]
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == left
    four = stages["secrets"](spark, three, sf_dir)
    assert four.columns == docs.columns
    clean = by_id(four)
    assert sorted(clean) == left and all(secrets.REDACTED in clean[d].text or clean[d].text == rows[d].text for d in left)
    five = by_id(stages["tokens"](spark, four, sf_dir))
    codec = sentencepiece.codec()
    assert sorted(five) == left and all(five[d].ids == codec.encode(clean[d].text) for d in left)


def test_pipeline_on_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline as P

    docs = odd
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns
    assert P.STAGES[-1][1](spark, docs, sf_dir).select(F.count("*")).first()[0] == docs.count()
    for _, stage in P.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_near_duplicates_stage_drops_rows_not_ids(spark):
    import corpus_pipeline as P

    copy, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, copy, 0), (5, copy, 1), (5, copy, 2), (5, other, 3), (None, copy, 4), (None, "only here and nowhere else at all", 5), (None, "only here and nowhere else at all", 6), (8, None, 7), (8, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = dict(P.STAGES)["near_duplicates"](spark, docs, "")
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and len(left) == 6
    assert left.count((5, copy)) == 1 and (5, other) in left and left.count((None, rows[5][1])) == 1 and left.count((8, None)) == 2 and (9, "") in left


def test_pipeline_without_labels_and_items(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    docs = table(spark, sf_dir, "documents").limit(60)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(P.STAGES)
    assert stages["quality"](spark, docs, str(tmp_path)).count() == 60 == stages["decontamination"](spark, docs, str(tmp_path)).count()
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "decodes", "ids"] and 0 < out.count() <= 60 and out.where("NOT decodes").count() == 0
