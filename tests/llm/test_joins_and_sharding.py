"""N-gram join, k-d sharding, top-k search and URL filter against brute force."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from variantlake.llm import kd_sharding, ngram_join, queries, topk_search, url_filter
from variantlake.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_links(texts, threshold=0.8):
    """(links of each text, class representative index of each text)."""
    sets = [grams(t) for t in texts]
    links, parent = [0] * len(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in by_gram[g] if j > i)
        for j, both in shared.items():
            if both >= threshold * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return links, [find(i) for i in range(len(texts))]


def check_join(rows, got):
    rows = sorted(rows, key=lambda r: r[0])
    links, root = brute_links([r[1] for r in rows])
    want = {r[0]: (links[i], rows[root[i]][0]) for i, r in enumerate(rows)}
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == want


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999, max_hashes=8)


def test_join_equals_brute_force_on_documents(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    check_join(rows, queries.op1(spark, SF_SMALL).collect())


def test_join_of_a_hot_group_spans_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for i in range(620):  # more than two blocks of near copies, with exact copies among them
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_join(rows, ngram_join.ngram_join(docs).collect())


def test_join_of_odd_rows(spark):
    long = " ".join(str(i) for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "  \n", "c"), (4, "one two", "d"), (5, "ONE  two", "e"), (6, long, "f"), (7, long + " x", "g"),
            (8, "three", "h"), (None, "three", "i"), (8, "three", "j")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, digest string, bucket int, links int")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == Counter([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (8, 8, 2), (8, 8, 2), (None, 8, 2)])
    kept = ngram_join.one_per_class(docs, ngram_join.ngram_join(docs)).collect()
    assert len(kept) == 6 and set(kept[0].asDict()) == set(docs.columns)
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_large_ids_beside_a_null_id_stay_exact(spark):
    big, words = 2**62 + 1, [f"w{i}" for i in range(60)]
    rows = [(None, "alone here", "en", "s", 1)] + [(big + 2 * i, " ".join([*words, f"x{i}"]), "en", "s", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, DOC).coalesce(1)
    joined = ngram_join.ngram_join(docs)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined.collect()} == {
        None: (None, 0), **{big + 2 * i: (big, 2) for i in range(3)}}
    kept = ngram_join.one_per_class(docs, joined).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([None, big])
    got = kd_sharding.kd_shards(docs, size=F.length("text"), dims=[F.length("text")], keep={"doc_id": F.col("doc_id"), "size": F.length("text")}, n_shards=2)
    assert dict(got.dtypes)["doc_id"] == "bigint" and Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def shard_check(rows, n_shards, largest):
    slots = defaultdict(list)
    size = Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    sizes = [size[i] for i in range(n_shards)]
    assert max(sizes) - min(sizes) <= 2 * largest


def test_shards_of_documents(spark):
    rows = queries.op2(spark, SF_SMALL).collect()
    docs = table(spark, SF_SMALL, "documents").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d["doc_id"], len(d["text"].encode()) + 16, zlib.crc32(d["text"].encode())) for d in docs)
    shard_check(rows, queries.N_SHARDS, max(r["size"] for r in rows))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_of_equal_and_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None)] * 40 + [(1, "same", "s")] * 40 + [(i, "x" * i, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    make = lambda d, **k: kd_sharding.kd_shards(d, size=size, dims=[F.col("doc_id"), F.col("source")],
                                                keep={"doc_id": F.col("doc_id"), "size": size}, **k)
    got = make(docs, n_shards=7).collect()
    assert len(got) == 120
    shard_check(got, 7, 56)
    assert make(docs.limit(0), n_shards=7).count() == 0
    assert {r["shard"] for r in make(docs.limit(1), n_shards=3).collect()} <= {0, 1, 2}
    assert len({r["shard"] for r in make(docs, target_bytes=1000).collect()}) == round(sum(r["size"] for r in got) / 1000)


def brute_shards(rows, n_shards):
    """Shard of each (dims, tie, size) row by the definition: widest dimension, weighted quantile."""
    n_dims = len(rows[0][0])
    span = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(n_dims)]
    out = []

    def split(part, first, count):
        if count == 1 or not part:
            out.extend((*r, first) for r in part)
            return
        spread = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / span[d] for d in range(n_dims)]
        d = spread.index(max(spread))
        part = sorted(part, key=lambda r: (r[0][d], r[1]))
        goal, below = sum(r[2] for r in part) * (count // 2) / count, 0
        for i, r in enumerate(part):
            if below + r[2] >= goal or i == len(part) - 1:
                break
            below += r[2]
        i += not goal - below < below + r[2] - goal
        split(part[:i], first, count // 2)
        split(part[i:], first + count // 2, count - count // 2)

    split(rows, 0, n_shards)
    return out


@pytest.mark.parametrize("few", [0, 1024])
def test_shards_equal_a_brute_force_tree(spark, monkeypatch, few):
    """Ids of both signs, extreme, tied and null; sources that differ after many letters."""
    monkeypatch.setattr(kd_sharding, "FEW", max(few, 1))
    rng = random.Random(6)
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, 0, rng.randrange(-(2**63), 2**63)]), rng.randrange(1, 40), rng.choice([None, "https://a", "https://b", "https://c", "x", ""])) for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string")
    keep = {"doc_id": F.col("doc_id"), "size": F.col("size"), "source": F.col("source")}
    dims = [F.col("doc_id"), F.col("source")]
    tie = F.shiftrightunsigned(F.xxhash64(*keep.values(), F.col("size"), *dims), 1)
    ties = {tuple(r)[:3]: r[3] for r in docs.select("doc_id", "size", "source", tie).collect()}
    rank = {s: i for i, s in enumerate(sorted({r[2] for r in rows} - {None}))} | {None: -1}
    brute = brute_shards([((-(2**63) if r[0] is None else r[0], rank[r[2]]), ties[r], r[1], r) for r in rows], 11)
    got = kd_sharding.kd_shards(docs, size=F.col("size"), dims=dims, keep=keep, n_shards=11).collect()
    assert Counter(((r["doc_id"], r["size"], r["source"]), r["shard"]) for r in got) == Counter((r[3], r[4]) for r in brute)


def test_shards_of_hash_ids_are_even(spark):
    docs = spark.range(4000).select(F.xxhash64("id").alias("doc_id"))
    got = kd_sharding.kd_shards(docs, size=F.lit(100), dims=[F.col("doc_id")], keep={"doc_id": F.col("doc_id")}, n_shards=8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [500] * 8


def brute_top(rows, k=20):
    vec = {i: (v_id, [np.floor(64 * float(x)) for x in v]) for i, (v_id, v) in enumerate(rows)
           if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, (q_id, q) in vec.items():
        if q_id is None or q_id % 20:
            continue
        hits = sorted((-int(np.dot(q, x)), v_id is None, v_id or 0) for j, (v_id, x) in vec.items() if j != i and len(x) == len(q))[:k]
        out += [(q_id, r, None if none else v_id, -s) for r, (s, none, v_id) in enumerate(hits, 1)]
    return Counter(out)


def test_topk_equals_brute_force(spark):
    vectors = table(spark, SF_SMALL, "embeddings")
    want = brute_top([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert Counter(tuple(r) for r in queries.op9(spark, SF_SMALL).collect()) == want


def test_topk_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_NUMBERS", 1024)  # several cells
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for i in range(700)]
    rows += [(20, rows[20][1]), (40, None), (60, [1.0, None]), (80, [float("nan")] * 6), (None, [0.5] * 6), (100, [1.0, 2.0]), (120, [0.1, 0.1]), (140, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = topk_search.top_k(df, is_query=F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows)
    assert topk_search.top_k(df.limit(0), is_query=F.col("vec_id") % 20 == 0).count() == 0


def test_topk_prunes_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_NUMBERS", 1 << 14)  # blocks of 512 rows
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40 if i % 3 else 0] + 0.1 * rng.normal(size=32)]) for i in range(6000)]  # a third in one cluster
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 20 == 0
    got = topk_search.top_k(df, is_query=is_query).select("query_id", "rank", "vec_id", "score")
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows)
    share = {r["level"]: r["share"] for r in topk_search.survival(df, is_query=is_query).collect()}
    assert sorted(share) == [0, 1, 4, 16, 32] and share[0] == 1
    assert share[16] < 0.25 and share[32] < 0.1 and share[1] >= share[4] >= share[16] >= share[32]


def test_ranges_bound_their_members():
    rng = np.random.default_rng(2)
    f = topk_search.segment_features(np.floor(rng.normal(size=(60, 37)) * 64), 16)
    bound = topk_search.box_bounds(f[:20], f[20:].min(axis=0)[None], f[20:].max(axis=0)[None])[:, 0]
    assert (bound + 1e-6 >= (f[:20] @ f[20:].T).max(axis=1)).all()
    x = np.floor(rng.normal(size=(50, 8)) * 64)
    least = topk_search.home_thresholds(x, np.array([0, 7]), 5)
    assert [np.sort(np.delete(x @ x[i], i))[-5] for i in (0, 7)] == list(least)
    assert (topk_search.home_thresholds(x[:5], np.array([0]), 5) == -np.inf).all()


def test_segment_features_bound_the_product():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(40, 37)) * 64)
    for s in (1, 4, 16, 64):
        f = topk_search.segment_features(x, s)
        assert (f @ f.T + 1e-6 >= x @ x.T).all()


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_verdicts_equal_brute_force(spark):
    urls = [r["url"] for r in table(spark, SF_SMALL, "pages").select("url").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "http://xnet/", "x://a.b.example.net/en/1?q#f",
             "x://example.net/en", "x://example.com/de/", "x://.org/fr/é", "a://b://c.net/", "x://net:80/", "x://a..net/?", "x://org/fr/" + "y/" * 3000, "x://É.NET/"]
    rules = [*queries.URL_RULES, ("com", "/d", "block"), ("a.net", "", "allow"), ("a.net", "", "allow")]
    pages = spark.createDataFrame([(i % 50 or None, u, "x") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark, rules)).collect()
    want = Counter((i % 50 or None, *brute_verdict(u, rules)) for i, u in enumerate(urls * 2))
    assert Counter(tuple(r) for r in got) == want
    none = url_filter.judge(pages, url_filter.rules_frame(spark, rules).limit(0)).collect()
    assert len(none) == len(urls) * 2 and {r["verdict"] for r in none} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def test_many_rule_shapes_keep_the_plan(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.{'a.' * (i % 7)}net" for i in range(300)]
    rules = [(rng.choice(hosts), "/" + "p" * n + rng.choice(["", "/"]), rng.choice(["allow", "block"])) for n in range(1000) for _ in range(3)]
    urls = [f"https://{rng.choice(['', 'x.', 'y.x.'])}{h}{p}{rng.choice(['', '/', 'p', 'q', '?p'])}" for h, p, _ in rng.sample(rules, 900)] + ["http://a" + ".a" * 5000 + "/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, url_filter.rules_frame(spark, rules))
    few = url_filter.judge(pages, url_filter.rules_frame(spark, rules[:3]))
    lines = [len(f._jdf.queryExecution().optimizedPlan().toString().splitlines()) for f in (got, few)]
    assert lines[0] == lines[1]
    best = {}
    for h, p, v in rules:
        best[h, p] = max(v, best.get((h, p), v), key=lambda w: w == "allow")

    def verdict(url):
        host, path = url.split("://", 1)[1].split("/", 1)
        path = "/" + path.split("?")[0]
        ends = {host.split(".", i)[-1] for i in range(min(20, host.count(".") + 1))}
        hits = [(len(h + path[:n]), best[h, path[:n]] == "allow", h + path[:n]) for h in ends for n in range(len(path) + 1) if (h, path[:n]) in best]
        return (max(hits)[2], "allow" if max(hits)[1] else "block") if hits else (None, "allow")

    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == {i: verdict(u) for i, u in enumerate(urls)}
