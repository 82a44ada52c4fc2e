import base64
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactframe.llm import language, mixing, packing, pii, queries, secrets, sharding, simhash, similar, topk, toxicity, transport

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, repeated rows, ties, a very long text.
ODD = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, "a b", "en", None, 3), (3, "a b", "en", None, 3), (None, "a b", None, "a", 3), (4, "word " * 60_000, "de", "a", 1), (5, " \n\t", "fr", "c", 3),
       (6, "x" * 5000, "en", "a", 5000), (7, "é漢 \U0001f600 ok", "es", "b", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        c.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return c


def same(df, relation):
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    a = sorted(map(tuple, df.select(*order).collect()), key=repr)
    columns = ", ".join(f'"{c}"' for c in order)
    return a == sorted(relation.project(columns).fetchall(), key=repr)


# Mixing.

def test_mixing_equals_sql(spark, duck):
    assert same(queries.op4_mixing(spark, DATA), duck.sql(mixing.MIX_SQL))


def test_mixing_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert mixing.mix(empty).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_water_filling_against_a_loop(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) for s in [*"abcdefg", None]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_repeated_documents(spark):
    df = spark.createDataFrame([(k, f"w{k} " * (k + 1), "en", "ab"[k % 2], 1) for k in range(40)], DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    words: dict[int, int] = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}


# Transport streams.

def test_transport_round_trip():
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 160, 161, 162, 176, 4095, 4096, 4097, 100_000, *(rng.randrange(9000) for _ in range(60))]:
        size, payload = transport.padded("x" * n)
        media = transport.write_stream(payload)
        found = transport.parse_stream(media)
        s = found["streams"][0]
        assert size == n and len(media) % 188 == 0 and s["data"] == payload and not s["continuity_errors"] and not found["sync_errors"]
        assert s["pts"] == [90_000 + 3600 * k for k in range(s["units"])] and s["random_access"] == [k % 8 == 0 for k in range(s["units"])]


def test_transport_notices_damage():
    media = transport.write_stream(bytes(range(256)) * 64)
    lost = media[:188 * 5] + media[188 * 6:]
    assert transport.parse_stream(lost)["streams"][0]["continuity_errors"] == 1
    repeated = media[:188 * 6] + media[188 * 5:]
    assert transport.parse_stream(repeated)["streams"][0]["continuity_errors"] == 0
    assert transport.parse_stream(b"\0" + media[1:])["sync_errors"] == 1
    assert transport.parse_stream(b"")["streams"] == [] and transport.section_crc(media[5:5 + 16]) == 0


def test_transport_query(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op3_transport(spark, str(tmp_path)).collect():
        text = next((t for i, t, *_ in ODD if i == r["doc_id"]), None) or ""
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert transport.parse_media(transport.store_texts(empty)).count() == 0


# Packing.

def check_pieces(rows, texts, window=1024):
    full = packing.encoder(queries.tokenizer_path()).full
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
    for doc, text in texts.items():
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_packing(spark, docs, odd, empty):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    sequences = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.limit(150).collect()})
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used / (1024 * len(sequences)) > 0.99
    own = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.pack(own, queries.tokenizer_path()).collect(), {r["doc_id"]: r["text"] for r in own.collect()})
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a b  c\n\n d  ", "it's 12 a_b  __ x", "\t\tq 'll 've", "É x·y ª º ² d7×÷", "<|endoftext|>x y", "a\x1cb \x85 c", "'s's S'RE 're", " a b ", "x" * 700 + " y", "漢字 かな a", "a b c d"])
def test_encoder_is_the_tokenizer(text):
    enc = packing.encoder(queries.tokenizer_path())
    for t in (text, text + " " + text):
        assert enc.encode(t).tolist() == enc.full.encode(t, add_special_tokens=False).ids


def test_plan_covers_everything():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 1024, 3000), np.full(500, 300), np.array([1]), np.full(64, 512), np.array([700] * 99 + [324] * 3)):
        rows = packing.plan(lengths, 1024)
        seen = {}
        for row in rows:
            assert sum(n for _, _, n in row) <= 1024
            for item, first, n in row:
                seen.setdefault(item, []).append((first, n))
        for k, n in enumerate(lengths.tolist()):
            at = 0
            for first, m in sorted(seen[k]):
                assert first == at
                at += m
            assert at == n
        assert sum(sum(n for _, _, n in row) < 1024 for row in rows) <= 1


# Personal data.

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_plain_identifiers_against_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a@b.1+ 2-(9)%\n0345") for _ in range(rng.randint(0, 40)))
        assert pii.plain_spans(text) == brute_spans(text)
    for text in ("a" * 200_000, "1" * 50_000, "1." * 30_000, "+1" * 50_000, "@" * 50_000):
        pii.find(text)


@pytest.mark.parametrize(("text", "kind", "shown"), [
    ("write to jane [at] mail dot example dot com now", "email", "jane [at] mail dot example dot com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("bob (at) site (dot) co", "email", "bob (at) site (dot) co"), ("call +1 four one five 555 two two 6 seven", "phone", "+1 four one five 555 two two 6 seven"),
    ("4 5 3 9 five 7 8 7 6 3 6 2 1 4 8 6", "card", "4 5 3 9 five 7 8 7 6 3 6 2 1 4 8 6"), ("at 192 dot 168 dot 1 dot 12", "ip", "192 dot 168 dot 1 dot 12"), ("x a​b@c.org", "email", "a​b@c.org"), ("jоhn@example.com", "email", "jоhn@example.com")])
def test_disguised_identifiers(text, kind, shown):
    plain, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [shown]


def test_clean_texts_have_no_disguise(spark, docs):
    assert queries.op6_pii(spark, DATA).where("n_disguised > 0").count() == 0
    for text in ("at the dot com", "one two three four five six", "meet me at noon. He said dot is a cat", "bob @ site"):
        assert not any(pii.find(text)[1].values())


def test_personal_data_query(spark, odd, empty, tmp_path):
    rows = [(1, None), (2, ""), (3, "a@b.c 1.2.3.4 4539578763621486 +1 (415) 555-2671"), (3, "a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op6_pii(spark, str(tmp_path)).collect():
        text = next(t for i, t in rows if i == r["doc_id"] and (i != 3 or len(t) > 9) == (i != 3 or r["n_ip"] > 0)) or ""
        spans = ",".join(f"{k}:{a}:{b}" for k, own in brute_spans(text).items() for a, b in own)
        assert r["spans"] == spans and r["base_sha256"] == sha256(spans.encode()).hexdigest()
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(empty).count() == 0


# Top-k.

def test_topk_equals_sql(spark, duck):
    assert same(queries.op7_topk(spark, DATA), duck.sql(topk.TOPK_SQL))


def test_topk_ties_and_odd_vectors(spark):
    rows = [(k, [float(k % 3), 0.5]) for k in range(130)] + [(500, None), (501, [None, 1.0]), (502, [float("nan"), 1.0]), (503, [float("inf"), 1.0]), (504, []), (505, [1.0]), (520, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = topk.search(v, v.where("vec_id % 20 = 0"), 20).collect()
    for q in (0, 20, 120):
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        score = lambda a, b: 64 * (a % 3) * 64 * (b % 3) + 32 * 32
        assert mine == sorted([(k, score(k, q)) for k in range(130) if k != q], key=lambda x: (-x[1], x[0]))[:20]
    assert not [r for r in got if r["query_id"] == 520]
    nothing = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(nothing, nothing).count() == 0


# SimHash.

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    ids = {f: [i for i, g in pairs if g == f] for f in {g for _, g in pairs}}
    parent = {f: f for f in ids}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in ids:
        for b in ids:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for f, own in ids.items():
        known = [i for i in own if i is not None]
        if known:
            least[root(f)] = min([*known, *([least[root(f)]] if root(f) in least else [])])
    return sorted(((i, f, least.get(root(f))) for i, f in pairs), key=repr)


def test_simhash_query_against_brute_force(spark, docs):
    texts = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op8_simhash(spark, DATA).collect()), key=repr)
    assert got == brute_components(texts)


def test_simhash_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t, *_ in ODD])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("node", [2048, 8])
def test_trie_links_connect_what_is_near(spark, node):
    rng = random.Random(6)
    values = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    want = {i: c for i, _, c in brute_components([(k, v) for k, v in enumerate(sorted(values))])}
    ordered = sorted(values)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v),) for v in ordered], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.trie_links(df, 3, node)).collect()}
    groups: dict = {}
    for k, v in enumerate(ordered):
        groups.setdefault(root.get(signed(v), signed(v)), set()).add(k)
    expected: dict = {}
    for k, c in want.items():
        expected.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


# Similar documents.

def test_similar_documents(spark, odd, empty):
    rng = random.Random(8)
    texts = {}
    for k in range(60):
        words = [f"w{rng.randrange(100_000)}" for _ in range(300)]
        texts[10 * k] = " ".join(words)
        for j in range(1, 3):
            copy = list(words)
            copy[rng.randrange(300)] = f"new{k}{j}"
            texts[10 * k + j] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()}
    assert got == {k: k // 10 * 10 for k in texts}
    rows = sorted((r["doc_id"] or 0, r["component_id"]) for r in similar.similar_documents(odd).collect())
    assert rows == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (5, 1), (6, 6), (7, 7)]
    assert similar.similar_documents(empty).count() == 0


def _brute_components(texts: dict[int, str], similarity: float) -> dict[int, int]:
    """The least id of each component of pairs of at least that exact similarity, by all pairs."""
    sets = {k: {tuple(w[j:j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))} for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_similar_documents_equal_brute_force(spark):
    """Isolated pairs around the threshold, short and long: none is lost, none linked below it."""
    rng = random.Random(31)
    texts = {}
    for k in range(300):
        n = rng.choice([8, 9, 30, 60, 200, 600])
        words = [f"w{rng.randrange(100_000)}" for _ in range(n)]
        texts[2 * k] = " ".join(words)
        cut = rng.uniform(0.05, 0.3)
        texts[2 * k + 1] = " ".join(words[:max(5, round(n * (1 - cut)))] + [f"v{rng.randrange(100_000)}" for _ in range(rng.randrange(3))])
    want = _brute_components(texts, 0.8)
    assert 60 < sum(want[k] != k for k in texts) < 240
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [3, 1024])
def test_sets_that_share_many_keys_meet_about_once(spark, block):
    """Copies share up to two hundred keys of their prefixes: the last join makes a few rows a pair, not one a key, and leaves no pair out."""
    rng = random.Random(33)
    texts = []
    for k in range(6):
        words = [f"w{rng.randrange(100_000)}" for _ in range((1000, 1060, 300)[k % 3])]
        for j in range(6):
            copy = list(words)
            for at in rng.sample(range(len(words)), len(words) // 60):
                copy[at] = f"new{k}{j}"
            texts.append((10 * k + j, " ".join(copy)))
    sets = similar.shingle_sets(spark.createDataFrame(texts, "doc_id long, text string"), 5, 0.8, ("doc_id",)).localCheckpoint()
    rows = similar.shared_keys(sets.select(F.explode("prefix").alias("key"), "node", F.size("prefix").alias("first"))).select("key", "node", F.col("node").alias("root")).localCheckpoint()
    x, y = rows.join(sets.drop("prefix"), "node").alias("x"), rows.join(sets.drop("prefix"), "node").alias("y")
    shared = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") > F.col("y.node")) & similar._may_be(0.8, "x", "y")).select("x.node", "y.node").collect()
    met = similar.meetings(rows, sets, 0.8, block).collect()
    assert {tuple(r) for r in met} == {tuple(r) for r in shared}
    pairs = len({tuple(r) for r in met})
    assert len(shared) > 50 * pairs and len(met) < 5 * pairs, (len(shared), len(met), pairs)


@pytest.mark.parametrize("size", [1100, 1900])
def test_wide_parities_rule_out_without_loss(spark, size):
    """Sets of unlike numbers of parities are compared by the fewer of them; only pairs below the similarity are ruled out, and those far below are."""
    rng = np.random.default_rng(34)
    base = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
    rows = []
    for k, (own, of) in enumerate([(size, size), (size, 0.95), (size, 0.9), (size, 0.8), (size, 0.6), (size, 0.2), (size, 0.0)]):
        part = base[:own] if k == 0 else np.concatenate([base[:round(own * of)], rng.integers(0, 2**63, round(own * 1.1) - round(own * of), dtype=np.uint64)]) if of < 0.9 else base[:round(own * of)]
        wide = similar.parities(part, 1 << (len(part) - 1).bit_length())
        rows.append((k, len(part), wide.tolist(), len(np.intersect1d(part, base[:size])) / len(np.union1d(part, base[:size]))))
    df = spark.createDataFrame(rows, "k long, n long, wide array<long>, alike double")
    seen = df.where("k = 0").alias("x").crossJoin(df.alias("y")).select("y.k", "y.alike", similar._may_be_wide(0.8, "x", "y").alias("may")).collect()
    assert all(r["may"] for r in seen if r["alike"] >= 0.8)
    assert not any(r["may"] for r in seen if r["alike"] < 0.5) and len({len(r[2]) for r in rows}) == 2


@pytest.mark.parametrize("block", [3, 1024])
def test_crowded_shingles_lose_no_link(spark, block):
    """All sets share a key; chains in which x is near y, and neither near the least, stay whole."""
    rng = random.Random(32)
    texts = {}
    for k in range(30):
        words = [f"w{rng.randrange(100_000)}" for _ in range(45)]
        for j in range(4):
            texts[10 * k + j] = " ".join(words[2 * j:2 * j + 36])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("_text", F.xxhash64("text"))
    sets = similar.shingle_sets(df, 5, 0.8, ("doc_id", "_text")).withColumn("prefix", F.concat("prefix", F.array(F.lit(1).cast("long"))))
    links = similar.components(similar.jaccard_links(sets, df, ["doc_id", "_text"], 5, 0.8, block=block)).collect()
    root = {r["node"]: r["root"] for r in links}
    found: dict[int, set[int]] = {}
    for r in sets.select("doc_id", "node").collect():
        found.setdefault(root.get(r["node"], r["node"]), set()).add(r["doc_id"])
    want: dict[int, set[int]] = {}
    for k, c in _brute_components(texts, 0.8).items():
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert any(len(g) > 1 for g in want.values())


# Language, toxicity, secrets.

def test_language_held_out_accuracy(spark, docs, odd, empty):
    got = queries.op9_language(spark, DATA).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    model = language.fit(docs)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in rows.values())
    assert language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}


def test_secrets_dictionary_counts_all_documents(spark):
    """A word of 8 in 400 documents is known though only about 20 documents are drawn for labelled findings."""
    rows = [(k, f"common words number{k} stand here " + ("quokkaword" if k % 50 == 0 else "")) for k in range(400)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"), most=20)
    assert {"common", "quokkaword"} <= model.words and "kk" in model.pairs


def test_kernel_is_the_shared_ngrams():
    flags = np.zeros(language.GRAMS, np.uint8)
    sets = []
    for t in ("the cat", "the dog", "été"):
        g = language.presence(t, flags)
        sets.append(set(np.flatnonzero(flags).tolist()))
        flags[g] = 0
    grams = np.array(sorted(sets[0] | sets[1]))
    z = np.array([[1 / np.sqrt(len(s)) if g in s else 0 for s in sets[:2]] for g in grams.tolist()], np.float32)
    model = language.LanguageModel(["a", "b"], grams, z, np.eye(2))
    for k, t in enumerate(("the cat", "the dog", "été")):
        want = [len(sets[k] & s) / np.sqrt(len(sets[k]) * len(s)) for s in sets[:2]]
        assert np.allclose(model.scores([t])[0], want, atol=1e-5)


def test_toxicity_held_out(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op2_toxicity(spark, DATA).where("held_out").join(labels, "doc_id").collect()
    assert not [r for r in got if r["predicted"] and not r["toxic"]]
    assert sum(r["predicted"] for r in got if r["toxic"]) >= 0.7 * sum(r["toxic"] for r in got)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.7 for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels.limit(0)).coefficients


@pytest.mark.parametrize(("tags", "want"), [("wIw", "I"), ("YwI", "A"), ("NI", "i"), ("RwwI", "q"), ("TwY", "H"), ("TwwwwwwY", "T"), ("IwY", "A"), ("www", ""), ("RNI", "q")])
def test_clause_grammar(tags, want):
    assert toxicity.clause_outcomes(tags) == want


def test_clauses_not_words():
    m = toxicity.ToxicityModel({"idiot ": 2.0}).matcher()
    place = {o: 1 + k for k, o in enumerate(toxicity.OUTCOMES)}
    assert m.features("You are an idiot.")[place["A"]] > 0 and m.features("He said idiot, then left")[place["q"]] > 0
    assert m.features("Not an idiot. You know")[place["i"]] > 0 and m.features("idiots and idiotic")[place["I"]] == 0


def test_secrets(spark, docs, odd, empty):
    model = secrets.fit(docs)
    made = secrets.lookalikes(sorted(model.words)[:500], each=40, seed=99)
    right = sum((model.share(np.array([model.vector(b + t, len(b), len(b) + len(t))]))[0] >= 0.5) == bool(y) for b, t, y in made)
    assert right / len(made) > 0.95
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: {(f["start"], f["end"]) for f in r["findings"]} for r in secrets.scan(docs, model).collect()}
    planted = [(i, m.span(1)) for i, t in texts.items() for m in re.finditer(r"(AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{12,}|(?<=token = \")[0-9a-f]{30,})", t)]
    assert planted and all(span in found[i] for i, span in planted)
    assert sum(map(len, found.values())) <= 1.1 * len(planted)
    rows = secrets.scan(odd, model, redact="[SECRET]").collect()
    assert len(rows) == len(ODD) and {r["clean"] for r in rows if r["doc_id"] == 1} == {None}
    token = base64.b64encode(bytes(range(30))).decode()
    one = secrets.scan(spark.createDataFrame([(1, f'x password="{token}" y')], "doc_id long, text string"), model, redact="[SECRET]").first()
    assert one["clean"] == 'x password="[SECRET]" y'
    assert secrets.scan(empty, model).count() == 0


# Sharding.

def test_sharding_law_and_slots(spark, docs, odd, empty):
    rows = queries.op10_sharding(spark, DATA).collect()
    counts: dict = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == docs.count() and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shards: dict = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 3
    assert sharding.balanced_shards(odd).count() == len(ODD) and sharding.balanced_shards(empty).count() == 0


def test_sharding_splits_a_hot_group_over_full_shards(spark):
    df = spark.createDataFrame([(k, "same" if k < 200 else f"t{k}") for k in range(480)], "doc_id long, text string")
    rows = sharding.balanced_shards(df).collect()
    held: dict = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r["doc_id"])
    assert {len(v) for v in held.values()} == {20}
    assert sum(any(d < 200 for d in v) for v in held.values()) <= 14
