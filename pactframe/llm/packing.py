"""Packing token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pactframe.llm.common import release, small_batches

#: White space but for spaces and line ends; texts with it, with white space beside a space, or with a longer word
#: than LONG_WORD, are encoded whole.
_ODD = re.compile(r"[^\S \n]")
LONG_WORD = 500
#: The tokenizer's own splitting.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of which a worker remembers the ids.
REMEMBERED = 80_000
_ENCODERS: dict[str, "Encoder"] = {}


def _bytes(token: str) -> bytes:
    """The bytes of a vocabulary entry: visible Latin-1 characters stand for themselves, the others, in order, for 256 and up."""
    return bytes(_BYTE[c] for c in token)


_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _VISIBLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


class Encoder(dict):
    """Ids of whole texts, as the tokenizer file gives them without added special tokens.

    A dict from what stands between two single spaces to the bytes of its ids
    with the space before, so that frequent words are encoded once per worker.
    The tokenizer's splitting never joins across such a space, but it looks at
    white space beside it: texts that have some there are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        ranks = {_bytes(t): i for t, i in self.full.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.quick = tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

        self.opens = np.array([self.quick.decode_single_token_bytes(i)[:1] == b" " for i in range(self.quick.n_vocab)])

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes new words at once; a word begins where an id begins with a space."""
        ids = np.array(self.quick.encode_ordinary(" " + " ".join(words)), np.uint16)
        raw, ends = ids.tobytes(), [*(2 * np.flatnonzero(self.opens[ids])).tolist(), 2 * len(ids)]
        return {w: raw[begin:end] for w, begin, end in zip(words, ends[:-1], ends[1:], strict=True)}

    def encode(self, text: str) -> np.ndarray:
        words = text.split(" ")
        odd = not text or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _ODD.search(text)
        if odd or any(s in text for s in self.special) or len(max(words, key=len)) > LONG_WORD:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint16)
        first = array("H", self.quick.encode_ordinary(words[0])).tobytes()
        parts = list(map(self.get, words[1:]))
        if None in parts:
            new = self.learn([w for w, p in zip(words[1:], parts, strict=True) if p is None])
            parts = [new[w] if p is None else p for w, p in zip(words[1:], parts, strict=True)]
            if len(self) > REMEMBERED:
                self.clear()
            self.update(new)
        return np.frombuffer(first + b"".join(parts), np.uint16)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def combinations(histogram: np.ndarray, window: int, most: int) -> np.ndarray:
    """Shallow combinations of present lengths that fill the window exactly.

    Rows of three lengths, 0 standing for none: powers of two alone (they need
    no padding), pairs, and triples of lengths that their partners leave over,
    at most `most` of these, the most frequent first.
    """
    present = np.flatnonzero(histogram)
    present = present[present > 0]
    alone = present[present & (present - 1) == 0]
    low = present[present <= window // 2]
    low = low[histogram[window - low] > 0]
    rows = [np.stack([alone, 0 * alone, 0 * alone], 1), np.stack([low, window - low, 0 * low], 1)]
    mirror = np.zeros_like(histogram)
    mirror[1:window] = histogram[1:window][::-1]
    over = np.flatnonzero(histogram[:window] > mirror[:window])
    over = over[over > 0]
    left = (histogram - mirror).clip(0)
    a, b = (x.ravel() for x in np.meshgrid(over, over))
    c = window - a - b
    fits = (a <= b) & (b <= c)
    a, b, c = a[fits], b[fits], c[fits]
    fits = left[c] > 0
    triples = np.stack([a[fits], b[fits], c[fits]], 1)
    order = np.argsort(-left[triples].min(1), kind="stable") if len(triples) else []
    rows.append(triples[order][:most])
    return np.concatenate(rows).astype(np.int64)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, column j of A counting the lengths of combination j.

    Multiplicative updates: as A and the histogram are not negative, x stays so
    and the error never grows.
    """
    h = histogram.astype(float)
    h[0] = 0
    real = combos > 0
    x = np.where(real, h[combos], np.inf).min(1) / 2 + 1e-9
    want = np.where(real, h[combos], 0).sum(1)
    for _ in range(rounds):
        have = np.bincount(combos.ravel(), (x[:, None] * real).ravel(), len(h))
        x *= want / np.maximum(np.where(real, have[combos], 0).sum(1), 1e-12)
    return x


def plan(lengths: np.ndarray, window: int, most: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first id, number of ids), for items shorter than the window.

    Rounded repeat counts are laid out as far as items are there; the
    residuals go greedily: the longest that fits the open sequence, or, where
    none fits, a cut of the longest that fills it.
    """
    histogram = np.bincount(lengths, minlength=window + 1)
    combos = combinations(histogram, window, most)
    items: dict[int, list[int]] = {}
    for k in np.argsort(lengths, kind="stable")[::-1].tolist():
        items.setdefault(int(lengths[k]), []).append(k)
    sequences: list[list[tuple[int, int, int]]] = []
    if len(combos):
        x = repeat_counts(combos, histogram)
        for j in np.argsort(-x, kind="stable").tolist():
            parts = [n for n in combos[j].tolist() if n]
            if len(parts) == 1:
                continue
            times = min([round(x[j]), *(len(items.get(n, ())) // parts.count(n) for n in parts)])
            sequences += [[(items[n].pop(), 0, n) for n in parts] for _ in range(times)]
    left = [(n, k, 0) for n, ks in items.items() for k in ks]
    left.sort()
    space, row = window, []
    while left:
        at = bisect_right(left, (space, len(lengths), window))
        n, k, first = left.pop(at - 1 if at else -1)
        take = min(n, space)
        row.append((k, first, take))
        if n > take:
            insort(left, (n - take, k, first + take))
        space -= take
        if not space:
            sequences.append(row)
            space, row = window, []
    if row:
        sequences.append(row)
    return sequences


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = 1024,
         block: int = 8192, block_ids: int = 1 << 22, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs whole texts, each followed by `end_id`, into sequences of at most `window` ids.

    One row per piece: `keep`, start (ids of the document before it), length,
    ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset, and the ids if asked for.  Full windows of a long document are
    sequences of their own; its tail joins others by `plan`, over blocks of
    `block` documents, fewer where these have `block_ids` ids (and the last
    document's, however long).  A block is bounded, lives in one task and leaves at
    most one sequence below the window, so no shuffle is needed and a lost
    task is simply run again with the same result.  Null and empty texts are
    the end id alone; an empty table gives no row; rows with equal ids are
    separate documents.  `tokenizer` is the path of a vocabulary below 65536
    ids whose splitting is that of byte_bpe_50k.
    """
    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else "")).fields)

    def over(batches):
        enc = encoder(tokenizer)
        base, made = TaskContext.get().partitionId() << 33, 0
        keys, ids, rows = [], [], []

        def add(k: int, first: int, n: int, offset: int) -> None:
            piece = ids[k][first:first + n].astype("<u4")
            rows.append((k, first, n, zlib.crc32(piece.tobytes()), len(ids[k]), base + made, offset, piece if with_ids else None))

        def flush():
            nonlocal made
            tails = []
            for k, own in enumerate(ids):
                whole = len(own) // window
                for w in range(whole):
                    add(k, w * window, window, 0)
                    made += 1
                if len(own) % window:
                    tails.append((k, whole * window, len(own) % window))
            for row in plan(np.array([n for _, _, n in tails], np.int64), window) if tails else []:
                offset = 0
                for item, first, n in row:
                    add(tails[item][0], tails[item][1] + first, n, offset)
                    offset += n
                made += 1
            table = pa.Table.from_batches(keys).combine_chunks()
            picked = table.take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [*picked.columns[:len(keep)], *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)]]
            if with_ids:
                columns.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
            out = pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches(max_chunksize=20_000)
            keys.clear(), ids.clear(), rows.clear()
            return out

        held = 0
        for batch in batches:
            begin, names = 0, batch.select(range(len(keep)))
            for k in range(batch.num_rows):
                own = np.append(enc.encode(batch.column(len(keep))[k].as_py() or ""), np.uint16(end_id))
                ids.append(own)
                held += len(own)
                if len(ids) >= block or held >= block_ids:
                    keys.append(names.slice(begin, k + 1 - begin))
                    yield from flush()
                    begin, held = k + 1, 0
            if begin < batch.num_rows:
                keys.append(names.slice(begin))
        if ids:
            yield from flush()
        release()

    small_batches(docs.sparkSession)
    return docs.select(*keep, text).mapInArrow(over, schema)
