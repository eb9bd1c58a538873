"""Reply trees, heap-bound clustering and spelling variants against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from os.path import commonprefix

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from variantlake.llm import chat_trees, heap_clusters, queries, spelling
from variantlake.llm.common import stored, table

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double, rid int, leaf string, mask int"
NASTY = ["\\", "<turn>", "<text>", "</turn>", "</turn>\n", "<\\turn>", "<", "\\\\</turn>", "\n", "é", "𝄞", "user", ""]


def oracle(name, sf_dir=SF_SMALL, tables=("conversations", "embeddings")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    return rel.columns, Counter(rel.fetchall())


def test_conversations_equal_the_sql(spark):
    got = queries.op11(spark, SF_SMALL)
    cols, want = oracle("op11_reply_tree_chats")
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == want
    row = got.where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def brute_paths(rows, best):
    """(tree, turns of a path) of each tree's best branches; node ids are distinct here."""
    kids, at = defaultdict(list), {(r[0], r[1]): r for r in rows}
    roots = []
    for r in rows:
        if r[2] is None or (r[0], r[2]) not in at:
            roots.append(r)
        else:
            kids[r[0], r[2]].append(r)
    found = defaultdict(list)
    stack = [[r] for r in roots]
    while stack:
        path = stack.pop()
        below = kids.get((path[-1][0], path[-1][1]))
        if below and path[-1][1] is not None:
            stack += [path + [r] for r in below]
        else:
            found[path[0][0]].append(path)
    out = Counter()
    for tree, paths in found.items():
        paths.sort(key=lambda p: (-sum(r[5] or 0 for r in p) / len(p), -len(p), p[-1][1]))
        for rank, p in enumerate(paths[:best], 1):
            out[tree, rank, tuple((r[3] or "", r[4] or "") for r in p)] += 1
    return out


def check_formatted(row):
    """The mask's offsets are code points of the formatted text; it covers assistants only."""
    for (role, text), m in zip(row["turns"], row["mask"]):
        assert row["formatted"][m["start"]:].startswith("<turn>")
        assert (m["loss_start"] is None) == (role != "assistant")
        if role == "assistant":
            span = row["formatted"][m["loss_start"]: m["loss_end"]]
            assert row["formatted"][m["loss_end"]:].startswith("</turn>\n")
            for mark in ("<turn>", "<text>", "</turn>"):
                assert mark not in span
                span = span.replace("<\\" + mark[1:], mark)
            assert span.replace("\\\\", "\\") == text
    assert row["loss_text"] == "".join(t for r, t in row["turns"] if r == "assistant")


@pytest.mark.parametrize("best", [1, 2, None])
def test_branches_equal_brute_force(spark, best):
    rng = random.Random(4)
    rows = []
    for tree in [None, *range(12)]:
        for n in range(rng.randrange(1, 25)):
            parent = rng.randrange(-2, n) if n else None
            text = "".join(rng.choice(NASTY) for _ in range(rng.randrange(6))) or None
            rows.append((tree, n, None if parent is not None and parent < 0 else parent, rng.choice(["user", "assistant", None, "</turn>\nx"]), text, rng.choice([0.0, 0.5, 1.0, None])))
    rows += [(50, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 1.0) for i in range(75)]  # a deep one
    rows += [(51, i, 0 if i else None, "user", "hub", float(i % 7)) for i in range(60)] + [(52, 1, 99, "assistant", "orphan", 1.0)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], NODES)
    got = chat_trees.read_back(chat_trees.format_paths(frame, best=best)).collect()
    assert Counter((r["tree_id"], r["path_rank"], tuple(map(tuple, r["turns"]))) for r in got) == brute_paths(rows, best)
    for r in got:
        check_formatted(r)
        assert r["n_turns"] == len(r["turns"])


def test_odd_reply_trees(spark):
    circle = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "under", 1.0), (1, 4, 4, "user", "self", 1.0), (1, 5, None, "user", "sound", 1.0)]
    twice = [(2, 1, None, "user", "low", 0.0), (2, 1, None, "user", "high", 2.0), (2, 2, 1, "assistant", "reply", float("nan"))]
    nameless = [(3, None, None, "user", "one", 1.0), (3, None, None, "user", "two", 1.0)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in circle + twice + nameless], NODES)
    got = chat_trees.read_back(chat_trees.format_paths(frame, best=None)).collect()
    assert Counter((r["tree_id"], tuple(t["text"] for t in r["turns"])) for r in got) == Counter(
        [(1, ("sound",)), (2, ("low",)), (2, ("high", "reply")), (3, ("one",)), (3, ("two",))])
    assert chat_trees.format_paths(frame.limit(0)).count() == 0


def test_turns_in_order_with_ties_and_nulls(spark):
    long = "word </turn> " * 40_000
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "system", None), (5, 2, "assistant", long), (5, 2, "assistant", long), (5, 1, None, "")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, node_id int")
    got = {r["tree_id"]: r for r in chat_trees.read_back(chat_trees.format_paths(chat_trees.from_turns(frame))).collect()}
    assert [tuple(t) for t in got[None]["turns"]] == [("system", ""), ("user", "a"), ("user", "b")]
    assert [tuple(t) for t in got[5]["turns"]] == [("", ""), ("assistant", long), ("assistant", long)]
    assert got[5]["loss_text"] == long + long


def test_chat_plan_is_native(spark):
    plan = queries.op11(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def brute_clusters(rows, k=16, dim=64, rounds=3):
    vec = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
           if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(vec, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min((far(v, m), j) for j, m in enumerate(c)) for _, v in vec]
        for j in range(len(c)) if turn < rounds else ():
            if own := [v for (_, v), (_, a) in zip(vec, at) if a == j]:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    sha_c = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha_c[j]) for (i, _), (d, j) in zip(vec, at))


def test_clusters_equal_brute_force_and_the_sql(spark):
    cols, want = oracle("op12_heap_bound_clusters")
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_SMALL, "embeddings").collect()]
    got = Counter(tuple(r) for r in queries.op12(spark, SF_SMALL).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == brute_clusters(rows)
    assert cols == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got == want


@pytest.mark.parametrize("n", [700, 9, 0])
def test_clusters_of_odd_vectors(spark, n):
    rng = random.Random(n)
    near = [[rng.gauss(8 * (i % 5), 0.4) for _ in range(3)] for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]
    if n > 100:  # copies, ties, wrong lengths, nulls, empty clusters
        rows += [(7, rows[7][1])] * 200 + [(None, [1.0, 2.0, 3.0])] * 3
        rows += [(1, None), (2, [1.0, None, 2.0]), (3, [float("nan")] * 3), (4, [1.0, 2.0]), (5, [float("inf"), 0.0, 0.0]), (6, [])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, key int")
    got = heap_clusters.cluster(frame, n_clusters=12, dim=3)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, k=12, dim=3)


def test_heaps_spare_most_vectors(spark):
    """After the first rounds most keys outlast the drift; every vector is in one place."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(8, 16)) * 400
    x = np.floor(centers[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 20)
    rows = stored(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rid long, vec array<double>"), "v")
    state = heap_clusters.fit(rows, [[int(v) for v in c] for c in np.floor(centers + 15)], 4)
    assert state.popped[0] == 4000 and sum(state.popped[1:]) < 400
    got = heap_clusters.assigned(state).collect()
    d = ((x[:, None, :] - np.array(state.centroids, float)[None]) ** 2).sum(axis=2)
    assert {r["rid"]: (r["cluster"], r["distance"]) for r in got} == {i: (int(row.argmin()), int(row.min())) for i, row in enumerate(d)} and len(got) == 4000


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    without = defaultdict(set)  # words one deletion away, and the same with a hole, are met by key
    for w in n:
        for i in range(len(w)):
            without["-", w[:i] + w[i + 1:]].add(w)
            without[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for (kind, key), words in without.items():
        if kind == "-":
            if key in n:
                near[key] |= words
                for w in words:
                    near[w].add(key)
        else:
            for w in words:
                near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None] += 1
    return out


def test_spelling_equals_brute_force_on_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 300)  # several blocks
    docs = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(docs))
    assert Counter(tuple(r) for r in queries.op13(spark, SF_SMALL).collect()) == want and any(r[1] for r in want)


def test_spelling_of_a_dense_vocabulary(spark, monkeypatch):
    """Words over two letters: prefixes shared by whole blocks, many near words, long chains."""
    monkeypatch.setattr(spelling, "BLOCK", 60)
    monkeypatch.setattr(spelling, "CELL_QUERIES", 100)
    rng = random.Random(2)
    n = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))): 2 + rng.randrange(9) ** rng.randrange(6) for _ in range(1500)}
    n |= {"aaaaaaa" + "b" * i: 2 * 10**i for i in range(9)} | {"ÿabcdefg": 3, "ÿabcdefgÀ": 30, "zabcdefg": 40, "x" * 5000: 5, "x" * 5001: 50}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    got = Counter(tuple(r) for r in spelling.variants(frame).collect())
    short = {w: k for w, k in n.items() if len(w) < 100}
    want = brute_variants(short) + Counter({("x" * 5000, "x" * 5001, "x" * 5001, 5, 1, 50): 1, ("x" * 5001, None, "x" * 5001, 50, 1, None): 1})
    assert got == want


def test_spelling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Variant VARIANT variants"), (3, "variant×variante variante ÷ Étéétéé étéétéé"), (4, "a" * 100_000 + " " + "b" * 7), (4, "a" * 100_000 + " " + "b" * 7)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    got = Counter(tuple(r) for r in spelling.variants(spelling.word_counts(frame)).collect())
    short = brute_words([(i, (t or "").replace("a" * 100_000, " ")) for i, t in rows])
    crc = zlib.crc32(("4:" + "a" * 100_000).encode())
    want = brute_variants(short) + Counter({("a" * (100_000 - (crc % 31 == 0)), None, "a" * (100_000 - (crc % 31 == 0)), 2, 0, None): 1})
    assert got == want
    assert spelling.variants(spelling.word_counts(frame.limit(0))).count() == 0


def test_scan_skips_ranges_and_finds_all():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(800)})
    queries_ = rng.sample(words, 120) + ["", "z"]
    listed = spelling.SortedList(words)
    got = {(queries_[i], words[j]) for i, j in zip(*spelling.scan(queries_, listed))}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = len(commonprefix([a, b]))
        return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]

    assert got == {(a, b) for a in queries_ for b in words if one_edit(a, b) and a[: max(0, len(a) - 1) // 2] == b[: max(0, len(a) - 1) // 2]}
