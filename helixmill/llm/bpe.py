"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. A sequence of tokens is the word's byte-pair encoding exactly if each
adjacent pair is (the pair's own text encodes to that pair), so a vectorised look-up tests all adjacent pairs of a batch
of words; a pair is proved once by exact merging and remembered. Only words with a failing pair are merged exactly.

Texts are cut at white space, which no token crosses: normalisation, splitting and encoding are done once for each
distinct piece, and a text's result is joined from its pieces. The special tokens of the file are recognised in the raw
text as the library does. Caches hold at most CACHE entries and CACHE_CHARS characters and are dropped when full; that
changes the time, not the result. The vocabulary file travels with the function, so executors need no file.

Defined cases: null text is encoded as the empty text (no token, decoded empty); rows are encoded independently, whatever
their ids; texts of any length are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

CACHE = 500_000
CACHE_CHARS = 32_000_000  # characters that a cache holds at most, beside those of one batch
END = "</w>"
#: The file's pattern for words, for lower-case ASCII.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordBpe:
    """Encoder of a tokenizer file whose words end in `</w>`."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        known = json.loads(spec)
        library = Tokenizer.from_str(spec)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = known["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in known["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.text = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.text_of = {str(i): t for i, t in self.text.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in known["model"]["merges"]]
        self.rank = {self.vocab[x] << 32 | self.vocab[y]: k for k, (x, y) in enumerate(pairs)}
        self.merged = [self.vocab[x + y] for x, y in pairs]
        self.longest = max(len(t) for t in self.vocab)
        self.pairs: dict[int, bool] = {}
        self.single: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.exact = self.piece_chars = self.word_chars = 0

    def merge(self, ids: list[int]) -> list[int]:
        """Exact byte-pair merging, lowest rank first and leftmost among equals."""
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none = self.rank, len(self.merged)
        ranks = [rank.get(x << 32 | y, none) for x, y in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            ids[k] = self.merged[low]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank.get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = rank.get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words: a heap of pairs over a linked list."""
        n, rank = len(ids), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := rank.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            to = after[k]
            if ids[k] < 0 or to >= n or rank.get(ids[k] << 32 | ids[to]) != r:
                continue
            ids[k], ids[to], after[k] = self.merged[r], -1, after[to]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (new := rank.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (new, x))
        return [x for x in ids if x >= 0]

    def symbols(self, token: str) -> list[int]:
        """Ids of the symbols of a token: its characters, the last with the word end if it has one."""
        vocab = self.vocab
        if token.endswith(END) and len(token) > len(END):
            return [*map(vocab.__getitem__, token[: -len(END) - 1]), vocab[token[-len(END) - 1 :]]]
        return [*map(vocab.__getitem__, token)]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match."""
        out, at, n, vocab = [], 0, len(word), self.vocab
        whole = word + END
        while at < n:
            if (t := vocab.get(whole[at:])) is not None:
                out.append(t)
                break
            for to in range(min(n - 1, at + self.longest), at, -1):
                if (t := vocab.get(word[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:
                raise ValueError(f"no token for {word[at]!r}")
        return out

    def encode_words(self, words: Iterable[str]) -> None:
        """Encode words that aren't known yet; self.words holds them then."""
        new = list(words)
        proposed = [self.propose(w) for w in new]
        size = np.fromiter(map(len, proposed), np.int64, len(new))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(new)), size)
        bad = np.zeros(len(new), dtype=bool)
        for keys, whose, known in (
            ((flat[:-1] << 32 | flat[1:])[owner[:-1] == owner[1:]], owner[1:][owner[:-1] == owner[1:]], self.pairs),
            (flat[np.repeat(size, size) == 1], owner[np.repeat(size, size) == 1], self.single),
        ):
            distinct, at = np.unique(keys, return_inverse=True)
            for k in (k for k in distinct.tolist() if k not in known):
                tokens = [k >> 32, k & 0xFFFFFFFF] if known is self.pairs else [k]
                known[k] = self.merge([x for t in tokens for x in self.symbols(self.text[t])]) == tokens
            good = np.fromiter((known[k] for k in distinct.tolist()), bool, len(distinct))
            if not good.all():
                bad[whose[~good[at]]] = True
        for k, (w, p) in enumerate(zip(new, proposed)):
            if bad[k]:
                self.exact += 1
                p = self.merge(self.symbols(w + END))
            self.words[w] = ids = " ".join(map(str, p))
            self.word_chars += len(w) + len(ids)
        if len(self.pairs) > CACHE:
            self.pairs.clear()

    def _words(self, piece: str) -> list[str]:
        """The words of a piece in the file's byte alphabet; plain ASCII takes a short cut through the same pattern."""
        if piece.isascii() and piece.isprintable():
            piece = piece.lower()
            return [piece] if piece.isalpha() else ASCII.findall(piece)
        return [w for w, _ in self.split(self.normalise(piece))]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces of text without white space; self.pieces holds their ids, joined by spaces."""
        todo = []
        for piece in pieces:
            if "<" in piece and len(parts := self.cut.split(piece)) > 1:
                todo.append((piece, [p if k % 2 else self._words(p) for k, p in enumerate(parts) if p]))
            else:
                todo.append((piece, [self._words(piece)]))
        self.encode_words({w for _, parts in todo for p in parts if isinstance(p, list) for w in p}.difference(self.words))
        words = self.words
        for piece, parts in todo:
            self.pieces[piece] = ids = " ".join([x for p in parts for x in ([words[w] for w in p] if isinstance(p, list) else (str(self.special[p]),))])
            self.piece_chars += len(piece) + len(ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its decoded text: all tokens joined by one space."""
        if len(self.pieces) > CACHE or self.piece_chars > CACHE_CHARS:  # what is still in use is taken back from the old half
            self.old, self.pieces, self.piece_chars = self.pieces, {}, 0
        if len(self.words) > CACHE or self.word_chars > CACHE_CHARS:
            self.words.clear()
            self.word_chars = 0
        cuts = [_pieces(t or "") for t in texts]
        new = {p for c in cuts for p in c}.difference(self.pieces)
        back = new.intersection(self.old)
        self.pieces.update(zip(back, map(self.old.__getitem__, back)))
        self.piece_chars += sum(len(p) + len(self.old[p]) for p in back)
        self.learn(new - back)
        pieces, text = self.pieces, self.text_of
        for c in cuts:
            ids = " ".join([x for x in map(pieces.__getitem__, c) if x])
            yield ids, " ".join(map(text.__getitem__, ids.split(" "))) if ids else ""


def _pieces(text: str) -> list[str]:
    """Pieces between white space; str.split() also cuts at four control characters that are none."""
    if re.search("[\x1c-\x1f]", text):
        return [p for p in re.split(r"[ \t-\r\x85\xa0  -     　]+", text) if p]
    return text.split()


def _worker_encoder(spec: str) -> WordBpe:
    """One encoder for each Python worker and file, kept between tasks."""
    kept = sys.modules.setdefault("_helixmill_bpe", types.ModuleType("_helixmill_bpe")).__dict__
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in kept:
        kept[name] = WordBpe(spec)
    return kept[name]


def encode_decode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256, and with ids=True the token ids."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(spec.value)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = list(encoder.encode(part.column(1).to_pylist()))
                columns = [part.column(0), pa.array([x.count(" ") + 1 if x else 0 for x, _ in found], pa.int64())]
                columns += [pa.array([digest(x) for x, _ in found]), pa.array([digest(y) for _, y in found])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.fromstring(x, dtype=np.int32, sep=" ") for x, _ in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids: the library's decode() of a file without a decoder joins tokens by a space."""
    with open(tokenizer_file, encoding="utf-8") as f:
        known = json.load(f)
    text = {i: t for t, i in known["model"]["vocab"].items()} | {x["id"]: x["content"] for x in known["added_tokens"]}

    @F.pandas_udf("string")
    def joined(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "" if x is None else " ".join(text[t] for t in x if t in text))

    return tokens.withColumn(out_col, joined(F.col(ids_col)))
