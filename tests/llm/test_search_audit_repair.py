"""Nearest neighbours in pruned graphs, the audit of filters, and the repair of conversations."""

import heapq
import random
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pactframe.llm import audit, common, conversations, graph, queries, topk

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


def by_name(df, relation):
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    columns = ", ".join(f'"{c}"' for c in order)
    return sorted(map(tuple, df.select(*order).collect()), key=repr), sorted(relation.project(columns).fetchall(), key=repr)


def duck_of(df, name, schema):
    c = duckdb.connect()
    c.execute(f"create table {name} ({schema})")
    rows = [tuple(r) for r in df.collect()]
    if rows:
        c.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return c


# Graphs.

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    """{query: [(score, id)]} by all cosines."""
    out = {}
    for q, v in asked:
        scores = [(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in rows if i != q and len(w) == len(v)]
        out[q] = sorted(scores, key=lambda s: (-round(s[0], 12), s[1]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in out.items()}


def test_graph_recall_on_the_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, [r for r in rows if r[0] % 50 == 0], 5), found(queries.op11_graph(spark, DATA))
    assert want.keys() == got.keys()
    assert all(len(got[q]) == 5 for q in want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    for q, own in got.items():
        assert [s for s, _ in own] == sorted((s for s, _ in own), reverse=True)
        assert all(abs(s - exact[q] @ exact[i] / np.sqrt(exact[q] @ exact[q] * (exact[i] @ exact[i]))) < 1e-12 for s, i in own)


@pytest.mark.parametrize("clusters", [1, 40])
def test_graph_recall_of_one_large_shard_and_of_many(clusters):
    """5,000 vectors, evenly spread or in tight clusters, against all cosines."""
    rng = np.random.default_rng(3)
    points = graph.unit(rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 5000)] * 3 * (clusters > 1) + rng.normal(size=(5000, 32)))
    edges, entries = graph.build(points.astype(np.float32))
    assert (edges >= 0).any(1).all() and edges.shape == (5000, graph.DEGREE)
    asked = points[::25]
    got = graph.beam_search(points.astype(np.float32), edges, entries, asked.astype(np.float32), graph.BEAM)[:, :6]
    want = np.argsort(-(asked @ points.T), 1)[:, :6]
    assert np.mean([len(set(g) & set(w)) / 6 for g, w in zip(got, want, strict=True)]) >= 0.9


def test_graph_pruning_keeps_diverse_edges():
    """A point, two neighbours close together in one direction, one in another: one of the two goes."""
    turn = lambda a: [np.cos(a), np.sin(a)]
    points = np.array([turn(0), turn(0.10), turn(0.11), turn(-0.2), turn(3)])
    assert graph.prune(points, np.array([[1, 2, 3, -1, 1, 0]]), np.array([0]))[0].tolist()[:3] == [1, 3, -1]


def test_graph_odd_vectors_copies_and_ties(spark):
    """Copies beyond any beam, scaled vectors, other lengths, repeated queries, values that overflow when squared; unfit rows take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)]  # copies
    rows += [(1000, [0.0] * 4), (1001, None), (1002, []), (1003, [1.0, None, 0.0, 0.0]), (1004, [float("nan"), 1.0, 1.0, 1.0]), (1005, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(1050, [1e200, 2e200, 3e200, 4e200]), (1100, [1.0, 2.0]), (1150, [2.0, 1.0]), (50, rows[50][1])]
    v = graph.sound(spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("q", "shard", "rank", "score", "query", "ids")}))
    got = graph.nearest(graph.stored_index(v, 150), v.where("vec_id % 50 = 0"), 5).collect()
    sound = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    scaled = [(i, (np.array(w) / np.abs(w).max()).tolist()) for i, w in sound]
    for q in (0, 50, 100, 150, 200, 1050, 1100, 1150):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        times = sum(i == q for i, _ in sound)
        want = brute(scaled, [next(s for s in scaled if s[0] == q)], 5)[q]
        assert len(own) == times * len(want)
        if q != 1050:  # the cosines of scaled vectors differ in their last digits
            assert [i for _, i, _ in own[::times]] == [i for _, i in want]
        assert np.allclose([s for *_, s in own[::times]], [s for s, _ in want], atol=1e-12)
    assert {r["query_id"] for r in got} == {0, 50, 100, 150, 200, 250, 300, 350, 400, 450, 1050, 1100, 1150}
    nothing = graph.sound(spark.createDataFrame([], VECTORS))
    assert graph.nearest(graph.stored_index(nothing), nothing).count() == 0


def test_ids_of_vectors_may_be_texts(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 120")
    named = v.withColumn("vec_id", F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    for search in (lambda d: topk.search(topk.quantised(d), topk.quantised(d).where("cast(vec_id as long) % 20 = 0"), 4),
                   lambda d: graph.nearest(graph.stored_index(graph.sound(d)), graph.sound(d).where("cast(vec_id as long) % 50 = 0"), 4)):
        got = sorted((int(r[0]), r[1], int(r[2]), r[3]) for r in search(named).collect())
        assert got == sorted(map(tuple, search(v).collect())) and got


def test_queries_in_rounds_give_the_same(spark, monkeypatch):
    """Rounds of at most 4,096 bytes: eight vectors of 64 components."""
    v = topk.quantised(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    asked, rounds = v.where("vec_id % 20 = 0"), []
    one = sorted(map(tuple, topk.search(v, asked, 20).collect()))
    monkeypatch.setattr(topk, "searched", lambda *a: common.searched(*a, round_bytes=4096))
    monkeypatch.setattr(common, "_by_length", lambda rows, k, f=common._by_length: rounds.append(rows.num_rows) or f(rows, k))
    assert sorted(map(tuple, topk.search(v, asked, 20).collect())) == one
    assert len(rounds) > 2 and sum(rounds) == 25


# Filters.

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_audit_equals_sql(spark, duck):
    got, want = by_name(queries.op12_audit(spark, DATA), duck.sql(audit.AUDIT_SQL))
    assert got == want and len(got) % 600 == 0


def odd_docs():
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["a", "bb", "Ccc", "x$y", "é漢"]) for _ in range(n))
    texts = [None, "", " \t\n", "a b", words(300), words(250), "W" * 50, "w " * 199, " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k % 100}" for k in range(200)), "x" * 98 + "AB", "x" * 97 + "ABC", "\x0b".join("ab"), "a\x1cb", "long " * 60_000]
    rows = [(i, rng.choice(texts), "en", rng.choice(["s", None, "", "t"]), 1) for i in range(200)]
    return rows + rows[:20] + [(None, "a b", "en", "s", 1), (None, None, None, None, None), (3, "other", "en", "s", 1)]


def counted(rows, labels):
    """The audit by sets of rows and walking through every order."""
    least, out, gap = {}, {}, " \t\n\x0b\x0c\r"
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = "".join(" " if c in gap else c for c in t).split(" ")
        w = [x for x in w if x]
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]), strict=True) if bad}
        docs.append((source or "", fails, *labels.get(i, (0, 0))))
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        made = []
        for order in map("".join, permutations("ABCDE")):
            alive = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in own[k][1]]
                redundant = sum(f in d[1] for d in own) - len(gone)
                alive = [k for k in alive if f not in own[k][1]]
                total[f] += len(gone)
                made.append((part, order, step, len(alive), len(gone), redundant, sum(d[1] == {f} for d in own), sum(own[k][2] for k in gone), sum(own[k][3] for k in gone)))
        out |= {m[:3]: (*m[3:], total[m[1][m[2] - 1]]) for m in made}
    return out


def test_audit_of_odd_rows_by_hand(spark, monkeypatch):
    """Nulls, repeated rows and ids, a long text, clashing columns, a hot text that is salted; labels with nulls, repeats and strangers."""
    rows = odd_docs()
    told = [(1, 1, 0), (2, None, 1), (3, 1, 1), (3, 0, 1), (5000, 1, 1), (None, 1, 1), (4, None, None)]
    labels = {1: (1, 0), 2: (0, 1), 3: (1, 1)}
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("part", "h", "mask", "n", "good", "toxic", "least", "_h", "_hot", "_salts", "bit", "before", "words")})
    monkeypatch.setattr(audit, "HOT_ROWS", 3)
    got = audit.interactions(audit.combinations(docs, spark.createDataFrame(told, "doc_id long, quality int, toxic int"))).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == counted(rows, labels)
    assert len(got) == len({tuple(r)[:3] for r in got})
    none = spark.createDataFrame([], DOCS)
    assert audit.combinations(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_compares_texts_where_hashes_agree(spark):
    """Every text of one made-up hash: the exact texts decide."""
    rows = [(i, t, "p", 5) for i, t in enumerate(["x", "y", "x", "z", "y", "x"])] + [(9, "q", "p", 6), (10, "q", "p", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, h long")
    got = audit.repeated_rows(docs.select("doc_id", "part", "h"), docs.select("doc_id", "part", "h", "text"))
    assert sorted(r[0] for r in got.collect()) == [2, 4, 5, 10]


# Conversations.

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, letters, lines) over all edits: paths by cost, then letters; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    done = []
    while heap:
        cost, letters, at, out = heapq.heappop(heap)
        if done and cost > done[0][0]:
            break
        roles = "".join(r[:1] or "?" for r, _ in out)
        tail = roles[1:] if roles[:1] == "s" else roles
        if any(c != "ua"[k % 2] for k, c in enumerate(tail)) or "s" in tail or (letters, at) in seen:
            continue
        seen.add((letters, at))
        if at == len(rows) and len(tail) % 2 == 0 and roles != "s":
            done.append((cost, letters, out))
            continue
        if letters.count("I") < 4:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, letters + "I", at, (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, out))
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                heapq.heappush(heap, (cost + extra, letters + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, letters + "R", at + 1, (*out, (new, text))))
    cost, letters, out = min(done)
    return cost, letters, sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(60))
def test_repair_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", " ", "umpire", ""]), f"t{k}.", rng.choice([0, 0, 0, 0, 1, 2, 3])) for k in range(rng.randrange(6))]
    repair = conversations.Repair()
    for row in rows:
        repair.add(*row)
    assert repair.result() == cheapest(rows)


def test_backpointers_go_to_a_file(monkeypatch):
    """The same edits, whatever is held in memory."""
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant", "system"]), str(k), rng.choice([0, 0, 0, 1, 3])) for k in range(5000)]
    results = []
    for held in (1 << 20, 64, 4):
        monkeypatch.setattr(conversations, "HELD_BYTES", held)
        repair = conversations.Repair()
        for row in rows:
            repair.add(*row)
        assert (repair.file is None) == (held == 1 << 20) and len(repair.back) <= max(held, 20_000)
        results.append(repair.result())
    assert results[0] == results[1] == results[2]
    assert sum(c != "I" for c in results[0][1]) == 5000


def test_repair_equals_sql(spark, duck):
    got, want = by_name(queries.op13_repair(spark, DATA), duck.sql(conversations.REPAIR_SQL))
    assert got == want and len(got) == 100


def odd_turns():
    rng = random.Random(4)
    texts = [None, "", " \n", "Yes.", "No!", "Why?", "cut off", "end. \t", "a", " ", "x" * 300_000 + "."]
    rows = [(rng.choice([*range(30), None]), rng.choice([*range(8), None]), rng.choice(["user", "assistant", "system", None, "", "tool", "User"]), rng.choice(texts)) for _ in range(300)]
    return rows + rows[:40] + [(99, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(3000)]


def test_repair_of_odd_rows_equals_sql(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a long text, a long conversation over several Arrow batches, clashing columns."""
    rows = spark.createDataFrame(odd_turns(), TURNS)
    wide = rows.withColumns({c: F.lit(7) for c in ("copy", "fault", "_draw", "gaps", "cost", "audit")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got, want = by_name(conversations.repaired(conversations.damaged(wide)), duck_of(rows, "conversations", "conv_id bigint, turn bigint, role varchar, text varchar").sql(conversations.REPAIR_SQL))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    none = spark.createDataFrame([], TURNS)
    assert conversations.repaired(conversations.damaged(none)).count() == 0


def test_conversation_that_loses_all_rows(spark):
    """Rows whose draw is 0 go, but their conversation stays with nothing."""
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repaired(conversations.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], TURNS))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
