"""Token ids in files, compressed by a Re-Pair grammar.

Documents are dealt by ranges of doc_id (missing ones last, then by hash of the text), so the files of all ranges, one after another, hold all ids in ascending order of doc_id. A task encodes
its texts and closes a file whenever it holds `ids_per_file` ids; a document is never cut. In each file the frequent pairs of neighbouring ids are replaced by nonterminals again and again:
in each round those pairs are taken, by falling frequency, that occur at least `LEAST` times (a rule must pay for itself), unless an id would be the left part of one and the right part of another;
so occurrences never overlap (a pair of equal ids is taken every other time in a run) and one pass replaces them all. Rounds end when one saves less than one symbol in `GAIN`. No pair holds the end id,
so every document begins at a symbol of its own.

Words() encodes each distinct word once, for tokenizers that drop white space and lower-case all letters: no piece of theirs crosses white space, so the ids of a text are those of its words. The
words themselves always go through the tokenizers library; those of small ASCII letters, which its normalizer and its cuts leave as they are, go to its model at once. Other tokenizers take whole texts (by_words=False).

A file is a header (magic, and the numbers of documents, rules, symbols, ids and terminals as unsigned 64-bit integers), then, little-endian: doc_ids (64 bits), whether they are known (8 bits), the
first symbol and the first id of each document and the totals (64 bits), left and right part of each rule (32 bits), the ids that it expands to (32 bits), and the symbols (24 bits, or 32 if there are
so many rules). The expansion lengths make random access cheap: File.ids(document, start, stop) finds the symbols by their running lengths and expands no others.

Files are rows of a Parquet table in the folder that executors share: range, file (number in the range), n_docs, n_ids, content. They are written once and read back from there.

Null texts are empty; they have the end id alone. Each row is a document: repeated rows are written repeatedly. Very long texts make a file of their own. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, running_totals, shared_folder, sized, spans

#: Marks that are a piece of their own, however many, behind letters; an apostrophe, which may open a contraction, isn't among them.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of U+00C0 to U+017F without multiplication and division signs and the one letter whose lower case is two characters, and ASCII letters.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
MAGIC, HEADER = b"RPGRAM01", struct.Struct("<8s5Q")
#: A pair becomes a rule if it occurs so often; rounds end when one saves less than one symbol in GAIN.
LEAST, GAIN = 6, 200
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are encoded together, and words that a worker remembers.
TOGETHER, REMEMBERED = 4_000_000, 500_000


@functools.lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def words_of(path: str) -> Words:
    return Words(tokenizer(path))


def chosen_pairs(codes: np.ndarray, counts: np.ndarray, n_symbols: int) -> list[int]:
    """Of pairs (left part in the high 32 bits) the most frequent ones in which no id is both a left and a right part."""
    role, out = bytearray(n_symbols), []  # 1 left, 2 right, 3 both parts of one pair
    for code in codes[np.lexsort((codes, -counts))].tolist():
        left, right = code >> 32, code & 0xFFFFFFFF
        if left == right:
            if not role[left]:
                role[left] = 3
                out.append(code)
        elif role[left] in (0, 1) and role[right] in (0, 2):
            role[left], role[right] = 1, 2
            out.append(code)
    return out


def frequent_pairs(code: np.ndarray, allowed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that occur LEAST times among those allowed, how often, and all places where one may be. Counts of hashed pairs, which are never too low, keep the rest out of the sort."""
    hashed = ((code.view(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero((np.bincount(hashed, minlength=1 << bits) >= LEAST)[hashed] & allowed)
    pairs, counts = np.unique(code[at], return_counts=True)
    often = counts >= LEAST
    return pairs[often], counts[often], at


def grammar(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """symbols, rules (left and right part of each) and the first nonterminal."""
    base = int(max(ids.max(initial=0), end)) + 1
    seq, rules, n = ids.astype(np.int32), [], base
    bits = min(20, max(8, len(seq).bit_length() - 2))
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        code = (a.astype(np.int64) << 32) | b
        pairs, counts, at = frequent_pairs(code, (a != end) & (b != end), bits)
        if not len(pairs):
            break
        new = np.sort(np.array(chosen_pairs(pairs, counts, n), np.int64))
        left, right = np.zeros(n, bool), np.zeros(n, bool)
        left[new >> 32] = True
        right[new & 0xFFFFFFFF] = True
        at = at[left[a[at]] & right[b[at]]]
        slot = np.searchsorted(new, code[at])
        hit = new[np.minimum(slot, len(new) - 1)] == code[at]
        at, slot = at[hit], slot[hit]
        twin = a[at] == b[at]
        if twin.any():  # in a run of one id, every other pair
            where = at[twin]
            opens = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (a[where[1:]] != a[where[:-1]])])
            first = where[np.maximum.accumulate(np.where(opens, np.arange(len(where)), 0))]
            keep = np.ones(len(at), bool)
            keep[twin] = (where - first) % 2 == 0
            at, slot = at[keep], slot[keep]
        seq[at] = n + slot
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        before, seq = len(seq), seq[stays]
        rules.append(np.stack([new >> 32, new & 0xFFFFFFFF], axis=1))
        n += len(new)
        if (before - len(seq)) * GAIN < before:
            break
    return seq.astype(np.int64), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), base


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to; a rule's parts come before it."""
    length = [1] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        length[i] = (length[a - base] if a >= base else 1) + (length[b - base] if b >= base else 1)
    return np.array(length, np.int64)


def pack(doc_ids: list, documents: list[np.ndarray], end: int) -> bytes:
    """The file of these documents."""
    ids = np.concatenate(documents)
    starts = np.cumsum([0] + [len(d) for d in documents])
    seq, rules, base = grammar(ids, end)
    length = rule_lengths(rules, base)
    place = np.concatenate([[0], np.cumsum(np.where(seq < base, 1, length[np.maximum(seq - base, 0)] if len(length) else 1))])
    first = np.searchsorted(place, starts)
    wide = base + len(rules) > 1 << 24
    symbols = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 4 if wide else 3]
    parts = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], np.uint8), first.astype("<u8"), starts.astype("<u8"), rules.astype("<u4"), length.astype("<u4"), symbols]
    return HEADER.pack(MAGIC, len(doc_ids), len(rules), len(seq), len(ids), base) + b"".join(p.tobytes() for p in parts)


class File:
    """Reads a file; its documents are numbered from 0."""

    def __init__(self, content: bytes):
        magic, n, n_rules, n_symbols, self.n_ids, self.base = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a file of grammar-compressed ids")
        at = HEADER.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n), take(np.uint8, n)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.first, self.starts = take("<u8", n + 1).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.rules, self.length = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
        width = 4 if self.base + n_rules > 1 << 24 else 3
        raw = take(np.uint8, width * n_symbols).reshape(-1, width)
        self.symbols = sum((raw[:, k].astype(np.int64) << (8 * k) for k in range(width)), np.zeros(n_symbols, np.int64))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        long = symbols >= self.base
        out[long] = self.length[symbols[long] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of these symbols: as long as nonterminals are left, each makes way for its two parts."""
        while True:
            long = symbols >= self.base
            if not long.any():
                return symbols.astype(np.uint32)
            at = np.cumsum(1 + long) - 1 - long  # where each symbol's first part goes
            out = np.empty(len(symbols) + int(long.sum()), np.int64)
            out[at[~long]] = symbols[~long]
            out[at[long]], out[at[long] + 1] = self.rules[symbols[long] - self.base].T
            symbols = out

    def dictionary(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions, one after another, and where each begins: terminals first, then the rules."""
        begin = self.base + np.concatenate([[0], np.cumsum(self.length)])
        return np.concatenate([np.arange(self.base, dtype=np.uint32), self.expand(np.arange(len(self.rules)) + self.base)]), np.concatenate([np.arange(self.base), begin[:-1]])

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document."""
        words, begin = self.dictionary()
        begin = begin[self.symbols]
        ids = words[spans(begin, begin + self.sizes(self.symbols))]
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            yield ids[a:b]

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Some ids of one document, by expanding only the symbols that hold them."""
        symbols = self.symbols[self.first[document] : self.first[document + 1]]
        ends = np.cumsum(self.sizes(symbols))
        stop = min(int(ends[-1]), int(ends[-1]) if stop is None else stop)
        if start >= stop:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = int(ends[i - 1]) if i else 0
        return self.expand(symbols[i:j])[start - skipped : stop - skipped]


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of a bounded size."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


class Words(dict):
    """Encodes texts word by word and remembers the words: the number of each leads to the place of its ids; see the module. Words that are looked up and not known are put down as new."""

    def __init__(self, model):
        super().__init__()
        self.model, self.new, self.flat, self.n = model, [], np.zeros(1024, np.uint32), 0
        self.begin, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))  # used: runs of texts that have the word
        closing = [i for w, i in model.get_vocab().items() if w.endswith("</w>")]
        self.closes = np.zeros(model.get_vocab_size() + 1, bool)
        self.closes[closing] = True
        self.plain = [x.id for x in model.model.tokenize("plain")] == model.encode("plain", add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def put(self, words: Sequence[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        if not words:
            return
        if self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(len(self.flat) + 2 * len(ids), np.uint32)])
        self.flat[self.n : self.n + len(ids)] = ids
        k = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.begin[k], self.size[k] = self.n + np.cumsum(sizes) - sizes, sizes
        self.n += len(ids)

    def each(self, words: list[bytes], ids_of: Callable[[list[str]], list[list[int]]]) -> None:
        for some in itertools.batched(words, 500):
            found = ids_of([w.decode() for w in some])
            self.put(some, np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def by_library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def by_model(self, words: list[str]) -> list[list[int]]:
        return [[x.id for x in self.model.model.tokenize(w)] for w in words]

    def letters(self, words: list[bytes]) -> None:
        """Words of letters, many in one text; each is one piece, and a piece ends with an id that closes it."""
        for some in itertools.batched(words, 500):
            ids = np.array(self.by_library([b" ".join(some).decode()])[0], np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self.put(some, ids, np.diff(ends, prepend=0))
            else:  # the tokenizer has no such closing ids
                self.each(some, self.by_library)

    def learn(self) -> None:
        """The ids of the new words. A word of letters with marks behind it is the word and the marks."""
        cut = [(w, w.rstrip(MARKS)) for w in self.new if not w.isalpha()]
        cut = [(w, x) for w, x in cut if len(x) < len(w) and (x.isalpha() or LETTERS.fullmatch(x))]
        parts = [part for w, x in cut for part in (x, w[len(x) :])]
        k = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))  # parts may be new, too
        more = np.zeros(len(self) - len(self.begin), np.int64)
        self.begin, self.size, self.used = (np.append(x, more) for x in (self.begin, self.size, self.used))
        marked = {w for w, _ in cut}
        rest = [w for w in self.new if w not in marked]
        plain = [w for w in rest if w.isalpha()] if self.plain else []
        self.each(plain, self.by_model)
        rest = [w for w in rest if not w.isalpha()] if self.plain else rest
        self.letters(letters := [w for w in rest if LETTERS.fullmatch(w)])
        letters = set(letters)
        self.each([w for w in rest if w not in letters], self.by_library)
        self.put([w for w, _ in cut], self.flat[spans(self.begin[k], self.begin[k] + self.size[k])], self.size[k].reshape(-1, 2).sum(axis=1))
        self.new = []

    def forget(self) -> None:
        """All words but those that several runs of texts have had of late, which are half of what is remembered at most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        kept = kept[self.used[kept] > 1]
        words = list(self)
        words = [words[i] for i in kept.tolist()]
        begin, size = self.begin[kept], self.size[kept]
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.flat, self.begin, self.size, self.used = self.flat[spans(begin, begin + size)], np.cumsum(size) - size, size, np.zeros(len(words), np.int64)
        self.n = len(self.flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > REMEMBERED:
            self.forget()
        # A special token's string must not arise by lower-casing or be cut: such texts go whole.
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if "<|" in t else t for t in texts], pa.string())))  # an empty word has no ids
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.learn()
        self.used[number] += 1
        at = coded.indices.to_numpy()
        size = self.size[number][at]
        begin = self.begin[number][at]
        ids = self.flat[spans(begin, begin + size)]
        place = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
        out = [ids[a:b] for a, b in itertools.pairwise(place.tolist())]
        for i in whole:
            out[i] = np.array(self.model.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str, by_words: bool) -> Callable[[list[str]], list[np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return words_of(path).encode if by_words else lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def write(docs: DataFrame, path: str, folder: str, end: int = 2, ids_per_file: int = 2_000_000, by_words: bool = False) -> None:
    """Writes the files of docs (doc_id, text), encoded with the tokenizer of the path, to the folder."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "doc_id", "text")

    def work(batches):
        encode = encoder(path, by_words)
        held, doc_ids, size, number, of = [], [], 0, 0, 0

        def file():
            columns = [pa.array([of], pa.int32()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(doc_ids, held, end)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["range", "file", "n_docs", "n_ids", "content"])

        for b in batches:
            ids, at = b.column(1).to_pylist(), 0
            for run in together(b.column(2).to_pylist()):
                of = b.column(0)[0].as_py()
                for own in encode(run):
                    held.append(np.append(own, np.uint32(end)))
                    doc_ids.append(ids[at])
                    size, at = size + len(held[-1]), at + 1
                    if size >= ids_per_file:
                        yield file()
                        held, doc_ids, size, number = [], [], 0, number + 1
        if held:
            yield file()

    in_arrow(dealt, "range int, file long, n_docs long, n_ids long, content binary", work).write.mode("errorifexists").parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and file, of all documents in the files of the folder."""
    files = spark.read.parquet(folder)
    starts = running_totals(files.select("range", "file", "n_ids"), [], ["range", "file"], {"base": "n_ids"}).select("range", "file", "base")
    placed = files.select("range", "file", "content").join(sized(starts), ["range", "file"]).select("range", "file", "base", "content")

    def work(batches):
        for b in batches:
            for of, number, base, content in zip(*b.columns, strict=True):
                file = File(content.as_buffer())
                rows = [(i, base.as_py() + int(a), len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, a, x in zip(file.doc_ids, file.starts[:-1], file.documents(), strict=True)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
                label = pa.array([f"{of.as_py()}-{number.as_py()}"] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], label], names)

    return in_arrow(placed, "doc_id long, start long, n_tokens long, ids_crc32 long, file string", work)


def token_files(docs: DataFrame, path: str, end: int = 2, folder: str | None = None, **parameters) -> DataFrame:
    """Writes docs to files of a new folder (or the one given) and returns what is read back from them."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, folder, end, **parameters)
    return read(docs.sparkSession, folder)
