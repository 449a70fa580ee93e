"""Byte-pair encoding by backtracking over longest tokens, and decoding by an offset table.

The merges of a vocabulary are never replayed.  An Aho-Corasick automaton over all tokens
gives the longest token that begins at every place of a word.  The encoder takes it if it
is compatible with the token before, that is if merging their joined symbols would leave
exactly these two; otherwise it tries the next shorter token there, and where none is left
it gives up the token before and marks the place as one that no encoding reaches.  A place
is given up at most once, so a word costs time in proportion to its length, and what comes
out is what the merges would have made: any two neighbours of their result are compatible,
and only one division of a word has that property.

Compatibility is kept in a table by pair.  Two tokens are incompatible if, at some time
while both are built, the part of the left one that touches the border and the part of the
right one can be merged earlier than either is merged into its own token; of equal merges
the one further left comes first.

The last symbol of a word differs from the same byte elsewhere (vocabularies with word
ends), so a word is a string over 512 symbols.  Texts are normalised as such vocabularies
ask: NFC, runs of white space as one space, lower case for each character on its own.  No
rule looks across white space, so long texts are worked on in stretches that end there.  A
word of a normalised stretch is encoded when a worker first meets it and then looked up, in
a table of bounded size; one that stands beside other punctuation, or in capitals, is the same.

Decoding joins the tokens' strings by spaces, as a vocabulary file without a decoder asks.
All strings stand in one buffer, with the offset of each; texts are gathered from it.

Nulls are empty texts and give no tokens.  Long texts are worked on whole.  Repeated rows
and clashing column names make no difference: columns asked for are passed on as they are,
and a column named like a result is an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

#: Words whose tokens a worker remembers, and how long these are at most.
REMEMBERED, LONGEST = 1_000_000, 64
#: Characters of a text that are cut into words at once, and on to the next white space.
STRETCH = 1 << 20
#: White space as vocabulary files' ``\s`` has it; Python's own notion has these four more.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _PIECES = re.compile(f"[{_SPACE}]"), re.compile(f"[^{_SPACE}]+")


def symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files: those that print stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A vocabulary file with merges and word ends, ready for encoding and decoding."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        kinds = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        cutters = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.end = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.end or kinds != ["NFC", "Replace", "Lowercase"] or file.get("decoder") or [c.get("type") for c in cutters] != ["Split", "ByteLevel"]:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.pattern = regex.compile(cutters[0]["pattern"]["Regex"].replace(r"\s", _SPACE))
        bytes_of = symbols()
        self.ids: dict[str, int] = {}
        strings = dict(model["vocab"])
        for token, i in strings.items():
            last = token.endswith(self.end) and len(token) > len(self.end)
            plain = [bytes_of[c] for c in (token[: -len(self.end)] if last else token)]
            if last:
                plain[-1] += 256
            self.ids["".join(map(chr, plain))] = i
        self.n = max(strings.values(), default=-1) + 1
        self.content, self.library, self.bytes_of = text, None, bytes_of
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        for s, i in self.special.items():
            strings[s] = i
        self.rank = [-1] * self.n
        self.parts: list[tuple[int, int] | None] = [None] * self.n
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, made = strings[a], strings[b], strings[a + b]
            if self.parts[made] is not None or max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("a token has two merges, or one before its parts have theirs")
            self.merge[left, right] = rank
            self.parts[made], self.rank[made] = (left, right), rank
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.length = [0] * self.n
        for s, i in self.ids.items():
            self.length[i] = len(s)
        self._automaton(self.ids)
        # A token that its own symbols are not encoded as, or with such a part, stands in no encoding.
        self.whole = bytearray(self.n)
        for i in sorted(self.ids.values(), key=self.rank.__getitem__):
            parts = self.parts[i]
            self.whole[i] = parts is None or (self.whole[parts[0]] and self.whole[parts[1]] and self.compatible(*parts, but=self.rank[i]))
        whole = {s: i for s, i in self.ids.items() if self.whole[i]}
        if len(whole) < len(self.ids):
            self._automaton(whole)
        self.texts = OffsetTable([s for s, _ in sorted(strings.items(), key=lambda t: t[1])], [i for _, i in sorted(strings.items(), key=lambda t: t[1])])
        self.numbers = OffsetTable([str(i) for i in range(max(strings.values()) + 1)], range(max(strings.values()) + 1))

    def _automaton(self, tokens: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        for s, i in tokens.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * self.n
        for s, i in tokens.items():
            self.shorter[i] = next((tokens[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in tokens), -1)

    def compatible(self, left: int, right: int, but: int = -1) -> bool:
        """Would merging leave these two tokens beside each other?  ``but``: a merge of the two themselves that does not count."""
        known = self.fits.get((left, right)) if but < 0 else None
        if known is not None:
            return known
        never = len(self.merge)
        rights = [(left, never)]  # parts of the left token that end at the border, each with the rank at which it is merged on
        while self.parts[rights[-1][0]]:
            part = rights[-1][0]
            rights.append((self.parts[part][1], self.rank[part]))
        lefts = [(right, never)]
        while self.parts[lefts[-1][0]]:
            part = lefts[-1][0]
            lefts.append((self.parts[part][0], self.rank[part]))
        good = True
        for a, a_ends in rights:
            for b, b_ends in lefts:
                rank = self.merge.get((a, b), never)
                if rank < a_ends and rank <= b_ends and rank != never and not (rank == but and a == left and b == right):
                    good = False
        if but < 0:
            self.fits[left, right] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one normalised word."""
        coded = word.encode()
        word = coded[:-1].decode("latin-1") + chr(256 + coded[-1])
        n = len(word)
        length, shorter, fits = self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token  # of tokens with one beginning, the longest ends last
        token = longest[0]
        if length[token] == n:
            return [token]
        dead = bytearray(n + 1)
        found: list[int] = []
        at, last = 0, -1
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    good = fits.get((last, token))
                    if good is None:
                        good = self.compatible(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at += length[token]
                last, token = token, longest[at] if at < n else -1
            else:
                dead[at] = 1
                gone = found.pop()
                at -= length[gone]
                last, token = found[-1] if found else -1, shorter[gone]
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised.

        Characters that Python's Unicode tables do not know yet (unassigned there) may be
        letters with a lower case to the tokenizers library, so what stands between white
        space around such a one is normalised and cut by the library's own tables.
        """
        if not _unknown(text):
            # Sigma at a word's end has a form of its own only where words are lower-cased whole.
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            self.library = Tokenizer.from_str(self.content)
        found: list[str] = []
        for piece in _PIECES.findall(text):
            if _unknown(piece):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                found += [bytes(self.bytes_of[c] for c in w).decode() for w, _ in cut]
            else:
                found += self.words(piece)
        return found


def _unknown(text: str) -> bool:
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH and (space := _SPACES.search(text, at + STRETCH)):
        yield text[at : space.end()]
        at = space.end()
    yield text[at:] if at else text


class OffsetTable:
    """Strings by number in one buffer, each followed by a space."""

    def __init__(self, strings: list[str], numbers: list[int] | range):
        coded = [s.encode() + b" " for s in strings]
        size = max(numbers, default=-1) + 1
        self.start, self.size = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lengths = np.array([len(c) for c in coded], np.int64)
        self.size[list(numbers)] = lengths
        self.start[list(numbers)] = np.cumsum(lengths) - lengths
        self.buffer = np.frombuffer(b"".join(coded), np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        """The strings of these numbers, joined by spaces."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        places = np.arange(ends[-1]) + np.repeat(self.start[numbers] - (ends - sizes), sizes)
        return self.buffer[places[:-1]].tobytes()


class Encoder:
    """Encodes whole texts, remembering the tokens of short words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = _Places(self)
        self.flat, self.start = array("i"), array("q", [0])

    def add(self, tokens: list[int]) -> int:
        """The place in the table where these tokens are put."""
        self.flat.extend(tokens)
        self.start.append(len(self.flat))
        return len(self.start) - 2

    def encode(self, text: str) -> np.ndarray:
        """All tokens of one text."""
        if len(self.start) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self._forget()
        if len(self.v.fits) > REMEMBERED:
            self.v.fits.clear()
        pattern, places, done = self.v.special_pattern, [np.zeros(0, np.int64)], 0
        for m in pattern.finditer(text) if pattern else ():
            places += [*self._places(text[done : m.start()]), [self.add([self.v.special[m.group()]])]]
            done = m.end()
        places = np.concatenate([*places, *self._places(text[done:])])
        flat, start = np.asarray(self.flat), np.asarray(self.start)
        counts = start[places + 1] - start[places]
        ends = np.cumsum(counts)
        return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[places] - (ends - counts), counts)]

    def _places(self, text: str) -> Iterator[np.ndarray]:
        """The place in the table of each word of a text without special tokens."""
        for stretch in _stretches(text):
            words = self.v.words(stretch)
            yield np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


class _Places(dict[str, int]):
    """Places in an encoder's table by word; a word that is not known is encoded, and a short one kept."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        place = self.encoder.add(self.encoder.v.encode_word(word))
        if len(word) <= LONGEST:
            self[word] = place
        return place


@lru_cache(2)
def _ready(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(2)
def _encoder(text: str) -> Encoder:
    return Encoder(_ready(text))


def load(path: str) -> str:
    """A vocabulary file's content, read where the driver runs and sent to the tasks (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _sent(spark: SparkSession, path: str):
    content = load(path)
    _ready(content)  # an unsuitable file is an error here, not in a task
    return spark.sparkContext.broadcast(content)


def encode(documents: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``, the tokens of each whole text by the vocabulary file at ``path``."""
    sent = _sent(documents.sparkSession, path)
    chosen = documents.select(*[f"`{c}`" for c in keep], documents[text].alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for at, n in _slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, n)
                found = [encoder.encode(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])

    return chosen.mapInArrow(work, ", ".join([*fields, "ids array<int>"]))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text that the tokens in ``ids`` give; a null or unknown token is left out, null ids give null."""
    sent = _sent(encoded.sparkSession, path)
    at = encoded.columns.index(ids)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _ready(sent.value).texts
        for batch in batches:
            texts = [None if i is None else _join(table, np.array([x for x in i if x is not None], np.int64)).decode("utf-8", "replace") for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(work, ", ".join([*fields, "decoded string"]))


def _join(table: OffsetTable, ids: np.ndarray) -> bytes:
    ids = ids[(ids >= 0) & (ids < len(table.size))]
    return table.join(ids[table.size[ids] > 0])


def digests(documents: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, decoded from its tokens again, and only digests sent on.

    The same as ``decode(encode(...))`` with both columns hashed, without texts and tokens leaving the task.
    """
    sent = _sent(documents.sparkSession, path)
    chosen = documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = _encoder(sent.value), _ready(sent.value)
        for batch in batches:
            rows = []
            for at, n in _slices(batch.column("text")):
                for t in batch.column("text").slice(at, n).to_pylist():
                    ids = encoder.encode(t or "")
                    rows.append((len(ids), sha256(v.numbers.join(ids)).hexdigest(), sha256(v.texts.join(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return chosen.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) so that few texts stand in memory as Python strings at once."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) and pa.types.is_string(texts.type) else np.full(len(texts), 1 << 20)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 4_000_000, "right")))
        yield at, min(n, len(texts) - at)
        at += n
