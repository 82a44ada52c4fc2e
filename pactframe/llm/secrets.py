"""Secret scans: candidate tokens, and a random forest that removes false positives."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import as_map, release, slices, small_batches, written

#: A candidate has a digit or mixed case in a run of 12 or more, or is what a secret's name is set to, or a URL's password.
_RUN = re.compile(r"[A-Za-z0-9_+/=.~@:-]{12,}")
_SET = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)[\"']?[ ]?[:=]+[ ]?[\"']?([^\s\"',;]{6,})")
_URL_PASSWORD = re.compile(r"://[^\s:/@]++:([^\s:/@]{6,}+)@")
_WORD = re.compile(r"[^\W\d_]{3,}")
_CLASS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
# Neighbouring words that speak for a secret or against it.
SECRET_WORDS = "password passwd pwd secret token key apikey api_key access credential auth bearer login private aws".split()
BENIGN_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid id version revision example sample placeholder test file path image url http https mail email".split()
FEATURES = ("length", "letters", "digits", "entropy", "class_changes", "transition", "dictionary", "hex", "slashes", "dots", "at_sign", "extension", "secret_words", "benign_words", "assigned", "repeats")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, in order, not overlapping; what a secret's name is set to comes first."""
    found = [m.span(1) for m in _SET.finditer(text)] if ("=" in text or ":" in text) else []
    found += [m.span(1) for m in _URL_PASSWORD.finditer(text)] if "://" in text else []
    first = set(found)
    for m in _RUN.finditer(text):
        begin, end = m.span()
        named = re.match(r"[A-Za-z_.-]*[:=]+", m.group())
        if named and named.end() < len(m.group()):
            begin += named.end()
        end -= len(text[begin:end]) - len(text[begin:end].rstrip(".:-"))
        token = text[begin:end]
        if len(token) >= 12 and (any(map(str.isdigit, token)) or not token.islower() and not token.istitle() and not token.isupper()):
            found.append((begin, end))
    out: list[tuple[int, int]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if out and span[0] < out[-1][1] and span in first and out[-1] not in first:
            out.pop()
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


class HashedWords:
    """A dictionary by sorted 64-bit hashes: eight bytes a word in each worker."""

    def __init__(self, words: frozenset[str]):
        self.hashes = np.sort(np.fromiter(map(self._hash, words), np.uint64, len(words)))

    @staticmethod
    def _hash(word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))

    def __contains__(self, word: str) -> bool:
        own = np.uint64(self._hash(word))
        at = int(np.searchsorted(self.hashes, own))
        return at < len(self.hashes) and self.hashes[at] == own


@dataclass
class SecretModel:
    """words: the dictionary; pairs: log probability of a letter pair; trees: (feature, cut, left, right, share) arrays."""

    words: frozenset[str] | HashedWords
    pairs: dict[str, float]
    trees: list[tuple[np.ndarray, ...]]

    def packed(self) -> SecretModel:
        """The same model in the form that tasks get."""
        return replace(self, words=HashedWords(self.words)) if isinstance(self.words, frozenset) else self

    def vector(self, text: str, begin: int, end: int) -> list[float]:
        token = text[begin:end]
        low = token.lower()
        n = len(token)
        before, after = text[max(0, begin - 48):begin].lower(), text[end:end + 24].lower()
        near = re.findall(r"[a-z_0-9]+", before)[-5:] + re.findall(r"[a-z_0-9]+", after)[:2]
        kinds = token.translate(_CLASS)
        counts = Counter(token)
        words = [w for w in _WORD.findall(low) if w in self.words]
        letters = sum(map(str.isalpha, token))
        return [
            float(n), letters / n, sum(map(str.isdigit, token)) / n,
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            sum(self.pairs.get(low[k:k + 2], -9.0) for k in range(n - 1)) / max(1, n - 1),
            sum(map(len, words)) / n,
            sum(c in "0123456789abcdef" for c in low) / n,
            float(token.count("/")), float(token.count(".")), float("@" in token),
            float(bool(re.search(r"\.[a-z]{2,4}\Z", low))),
            float(sum(w in SECRET_WORDS for w in near)), float(sum(w in BENIGN_WORDS for w in near)),
            float(bool(re.search(r"[:=][\s\"']*\Z", before))),
            max(counts.values()) / n,
        ]

    def share(self, x: np.ndarray) -> np.ndarray:
        """The forest's mean share of secrets in the leaves that the rows of `x` reach."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), feature[at].clip(0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 11) -> list[tuple[np.ndarray, ...]]:
    """Gini trees over bootstrap samples; each split looks at a random few features and at 32 quantiles of them."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    few = max(2, int(math.sqrt(x.shape[1])) + 1)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, left, right, value = [], [], [], [], []

        def split(own: np.ndarray, level: int) -> int:
            node = len(feature)
            feature.append(-1), cut.append(0.0), left.append(node), right.append(node), value.append(float(y[own].mean()))
            if level == depth or len(own) < 4 or value[node] in (0.0, 1.0):
                return node
            best = (value[node] * (1 - value[node]) * len(own) - 1e-9, -1, 0.0)
            for f in rng.permutation(x.shape[1])[:few]:
                below = x[own, f][:, None] <= cuts[f][None]
                n = below.sum(0)
                ones = (below & (y[own] > 0)[:, None]).sum(0)
                other, rest = len(own) - n, y[own].sum() - ones
                cost = ones * (1 - ones / np.maximum(n, 1)) + rest * (1 - rest / np.maximum(other, 1))
                cost[(n == 0) | (other == 0)] = np.inf
                if len(cost) and cost.min() < best[0]:
                    best = (cost.min(), int(f), float(cuts[f][cost.argmin()]))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                below = x[own, best[1]] <= best[2]
                left[node] = split(own[below], level + 1)
                right[node] = split(own[~below], level + 1)
            return node

        split(rows, 0)
        forest.append(tuple(np.array(a) for a in (feature, cut, left, right, value)))
    return forest


def labelled_finding(token: str, before: str) -> int | None:
    """The label that a finding's form settles: 1 secret, 0 not, None unsettled."""
    if re.fullmatch(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", token):
        return 1
    if re.search(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?[ ]?[:=]+[ ]?[\"']?\Z", before) and len(set(token)) > 7 and re.search("[0-9]", token):
        return 1
    if re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|[0-9.:/-]+|[A-Za-z]+(?:[-_.][A-Za-z]+)*", token):
        return 0
    if re.fullmatch(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|https?://\S+|[\w.-]*/[\w./-]+\.[a-z]{2,4}", token):
        return 0
    return None


def lookalikes(words: list[str], each: int = 150, seed: int = 5) -> list[tuple[str, str, int]]:
    """Seeded labelled findings (before, token, label) of kinds that a corpus may show rarely."""
    rng = random.Random(seed)
    word = lambda: rng.choice(words)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, c=chars: "".join(rng.choice(c) for _ in range(n))
    digest = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    out = []
    for _ in range(each):
        lead = f"{word()} {word()} "
        name = rng.choice(["password", "secret", "token", "api_key", "access_key", "pwd"])
        sign = rng.choice(["=", ": ", " = ", '="', ': "'])
        out += [
            (lead + name + sign, some(rng.randint(12, 40)), 1), (lead + name + sign, digest()[:rng.randint(16, 40)], 1),
            (lead + rng.choice(["bearer ", "auth ", "key ", ""]), some(rng.randint(24, 44)), 1), (lead, "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 1),
            (lead + name + sign, base64.b64encode(rng.randbytes(rng.randint(15, 30))).decode(), 1),
            (lead + rng.choice(["commit ", "sha1 ", "revision "]), digest(), 0), (lead + rng.choice(["sha256:", "checksum ", "md5 "]), hashlib.sha256(digest().encode()).hexdigest()[:rng.choice([32, 64])], 0),
            (lead + rng.choice(["id ", "uuid "]), str(uuid.UUID(bytes=rng.randbytes(16))), 0), (lead, "/".join(["", word(), word(), f"{word()}{rng.randint(1, 99)}.{rng.choice(['py', 'txt', 'png', 'html'])}"]), 0),
            (lead, f"https://{word()}{rng.randint(1, 9)}.example.com/{word()}/{word()}", 0), (lead + name + sign, rng.choice(["your_password_here1", "example_token_123", "changeme123456", "xxxxxxxxxxxxxxxx1", "<your-api-key-1>", "PLACEHOLDER_KEY_1"]), 0),
            (lead, f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example.com", 0), (lead, "".join(str(rng.randint(0, 9)) for _ in range(rng.randint(12, 19))), 0),
            (lead, f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}:{rng.randint(1000, 9999)}", 0), (lead, f"{word().title()}{word().title()}{word().title()}{rng.randint(1, 99)}", 0),
            (lead, f"{word()}-{word()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", 0), (lead, f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}:{rng.randint(10, 59)}:00", 0),
        ]
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n, the number of distinct texts of the one column of `texts` that hold it; of the empty word, the number of distinct texts.

    What moves is one row a distinct text and task: its 64-bit hash and its
    words, each once, not the text.
    """

    def over(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                hashes, words = [], []
                for t in part.column(0).to_pylist():
                    h = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
                    if h not in seen:
                        seen.add(h)
                        hashes.append(h)
                        words.append(" ".join(sorted(set(_WORD.findall(t.lower())))))
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.string())], names=["h", "words"])
        release()

    small_batches(texts.sparkSession)
    own = texts.mapInArrow(over, "h long, words string").groupBy("h").agg(F.min("words").alias("words"))
    word = F.explode(F.concat(F.array(F.lit("")), F.filter(F.split("words", " "), lambda w: w != "")))
    return own.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, most: int = 8_000, findings: int = 6_000, text: str = "text", share: float = 5e-5) -> SecretModel:
    """Trains dictionary, letter transitions and forest on findings labelled by their form.

    Words and letter pairs are counted over all distinct texts.  The dictionary
    has the words of at least two texts and a `share` of them: a text adds one
    to each of its words, so it has at most 1 / share times the mean number of
    words of a text, at every corpus size.  Letter pairs are those of all words
    of two texts.  Only labelled findings come from about `most` documents,
    chosen by a hash of the text, at most `findings` of them, and from seeded
    look-alikes.  The forest sees none of the forms, only FEATURES.
    """
    total = docs.count()
    present = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    sample = present.where(F.pmod(F.xxhash64("text", F.lit("secrets")), F.lit(1_000_000)) / 1e6 < min(1.0, most / max(1, total))).distinct()
    counted = written(word_counts(present).where("n >= 2 or word = ''"), "secret-words")
    least = share * sum(r["n"] for r in counted.where("word = ''").collect())
    counted = counted.where("word <> ''")
    words = frozenset(r["word"] for r in counted.where(F.col("n") >= least).select("word").toLocalIterator())
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(2))))
    pairs = {r["pair"]: r["n"] for r in counted.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    every = sum(pairs.values()) or 1
    model = SecretModel(words, {p: math.log(n / every) for p, n in pairs.items()}, [])
    light = model.packed()

    def found(batches):
        for batch in batches:
            x, y = [], []
            for t in batch.column(0).to_pylist():
                for begin, end in candidates(t):
                    label = labelled_finding(t[begin:end], t[max(0, begin - 48):begin])
                    if label is not None:
                        x.append(light.vector(t, begin, end))
                        y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(found, "y long, x array<double>")
    rows = rows.orderBy(F.xxhash64("x"), "x").limit(findings).collect()
    made = [(model.vector(b + t, len(b), len(b) + len(t)), y) for b, t, y in lookalikes(sorted(words)[:2000] or ["word"])]
    x = np.array([list(r["x"]) for r in rows] + [v for v, _ in made])
    y = np.array([r["y"] for r in rows] + [label for _, label in made], float)
    model.trees = grow_forest(x, y)
    return model


def scan(docs: DataFrame, model: SecretModel, threshold: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: str | None = None) -> DataFrame:
    """`keep`, n_candidates and findings (start, end, score) of every whole text, in code points.

    Findings are the candidates that the forest scores at `threshold` or
    above.  With `redact`, the text follows, with that in place of each
    finding.  Null and empty texts have no candidate (and stay as they are);
    equal rows give equal rows, ties at the threshold are findings, texts of
    any length are scanned whole, columns that are not in `keep` are not
    read, and an empty table gives no row.
    """
    extra = "n_candidates int, findings array<struct<start:long,end:long,score:double>>" + (", clean string" if redact is not None else "")
    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL(extra).fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def over(batch):
        m = shared.value
        texts = batch.column(len(keep)).to_pylist()
        spans = [candidates(t or "") for t in texts]
        x = np.array([m.vector(t, *s) for t, own in zip(texts, spans, strict=True) for s in own]).reshape(-1, len(FEATURES))
        scores = iter(m.share(x).tolist())
        found, clean = [], []
        for t, own in zip(texts, spans, strict=True):
            kept = [{"start": a, "end": b, "score": p} for (a, b), p in [(s, next(scores)) for s in own] if p >= threshold]
            found.append(kept)
            if redact is not None and kept:
                ends = [0, *(f["end"] for f in kept)]
                t = "".join(t[a:f["start"]] + redact for a, f in zip(ends[:-1], kept, strict=True)) + t[ends[-1]:]
            clean.append(t)
        columns = [*batch.columns[:len(keep)], pa.array(list(map(len, spans)), pa.int32()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if redact is not None else []), names=schema.names)

    return as_map(docs.select(*keep, text), over, schema)
