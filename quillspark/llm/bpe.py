"""Byte-pair encoding of whole texts through distinct pieces; the global distinct-word encoder and decoder."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, shuffle_parts, table

#: Distinct pieces whose ids a Python worker keeps between batches, in either generation.
CACHED = 200_000
#: Bytes of the texts whose pieces are looked up together.
SLICE_BYTES = 4 << 20

_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")


def vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file; read on the driver and broadcast, as its size is fixed."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(vocab: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line)}


def blank_pieces(text: str) -> list:
    """Pieces of a text, cut before each blank that follows no white space.

    The pre-token pattern never matches across such a place, so pieces are encoded apart. A piece that begins with
    the blank is given without it, any other as a one-tuple.
    """
    return [p[1:] if p[0] == " " else (p,) for p in _BEFORE_BLANK.split(text) if p]


class Known(dict):
    """Ids of pieces in two generations: once the young one is full it becomes the old one, whose pieces return when met.

    A lookup of an unknown piece gives None and notes the piece, to be learned.
    """

    def __init__(self, most: int) -> None:
        self.most, self.old, self.missed = most, {}, []

    def __missing__(self, piece) -> bytes | None:
        ids = self.old.get(piece)
        if ids is None:
            self.missed.append(piece)
        else:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: The pre-tokens of the usual byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters below U+0130, then ASCII marks: two pre-tokens of any pattern used here.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-/:-@\[-`{-~]*)").fullmatch
#: How byte-level vocabularies write each byte: those that are no printable Latin-1 character from U+0100 on.
_UNSHOWN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
SHOWN = [chr(0x100 + _UNSHOWN.index(b)) if b in _UNSHOWN else chr(b) for b in range(256)]


def shown(word: str) -> str:
    return word if word.isascii() and word.isprintable() and " " not in word else "".join([SHOWN[b] for b in word.encode()])




def numbered_pieces(texts: pa.Array, cut: Callable[[pa.Array], pa.ListArray], odd: str, pieces: Callable[[str], list], first_apart: bool) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct pieces of ``texts``, the numbers of all pieces in their order, and where in those each text begins and ends.

    Texts are cut by ``cut``, those that match the expression ``odd`` (RE2) by ``pieces``. With ``first_apart`` a
    text's first piece is numbered as a one-tuple. The numbering depends on the texts alone.
    """
    apart = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
    lists = cut(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts)
    places = lists.flatten().dictionary_encode()
    cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)))
    names, k = places.dictionary.to_numpy(zero_copy_only=False).tolist(), places.indices.to_numpy().astype(np.int64)
    if first_apart:
        first = cuts[:-1][np.diff(cuts) > 0]
        distinct, inverse = np.unique(k[first], return_inverse=True)
        k[first] = len(names) + inverse
        names += [(names[i],) for i in distinct.tolist()]
    if apart.any():
        number = {p: i for i, p in enumerate(names)}
        runs, n, at = [], np.diff(cuts), 0
        for i in np.flatnonzero(apart).tolist():
            own = [number.setdefault(p, len(number)) for p in pieces(texts[i].as_py())]
            runs += [k[at : cuts[i]], np.array(own, dtype=np.int64)]
            at, n[i] = cuts[i + 1], len(own)
        names, k, cuts = list(number), np.concatenate([*runs, k[at:]]), np.concatenate(([0], np.cumsum(n)))
    return names, k, cuts


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of ``texts`` of at most ``size`` bytes: first, last + 1. A longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


#: A blank that follows white space, of any kind.
_WIDE = r"[\s\v\x1c-\x1f\x{85}\p{Z}] "


def numbered_blank_pieces(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    return numbered_pieces(texts, lambda t: pc.split_pattern(t, " "), _WIDE, blank_pieces, True)


def piece_text(piece) -> str:
    """The text that a piece of ``blank_pieces`` stands for."""
    return " " + piece if isinstance(piece, str) else piece[0]


class PieceEncoder:
    """Ids of texts by a tokenizers file, from the ids of their distinct pieces.

    Texts are cut at places that no pre-token crosses; the distinct pieces of a slice of texts are looked up in a
    dictionary kept between calls, what is new is encoded, and the texts' ids are put together by place. Ids are
    below 65,536. A text that holds the string of a special token is encoded as a whole, and one that Arrow can't
    cut at the right places is cut here.
    """

    def __init__(self, vocab: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known = Known(CACHED)

    def numbered(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def words(self, piece) -> list[str] | None:
        """The pre-tokens of a piece in the bytes' shown form; None for a piece to be encoded as a text."""
        raise NotImplementedError

    def text_of(self, piece) -> str:
        return piece

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _lookup(self, pieces: list) -> list[bytes]:
        known = self.known
        known.age()
        found = list(map(known.__getitem__, pieces))
        if not known.missed:
            return found
        new = list(dict.fromkeys(known.missed))
        known.missed.clear()
        by_word: dict[str, bytes] = {}
        tokenize = self.model.tokenize
        for p in new:
            words = self.words(p)
            if words is None:
                known[p] = self.whole(self.text_of(p))
                continue
            for w in words:
                if w not in by_word:
                    by_word[w] = array("H", [t.id for t in tokenize(w)]).tobytes()
            known[p] = by_word[words[0]] if len(words) == 1 else b"".join([by_word[w] for w in words])
        return [known[p] if f is None else f for p, f in zip(pieces, found, strict=True)]

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        names, k, cuts = self.numbered(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        found = self._lookup(names)
        table = np.frombuffer(b"".join(found), dtype="<u2")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        starts = np.cumsum(sizes) - sizes
        n = sizes[k]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = table[np.repeat(starts[k] - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[cuts].tolist()
        for i, whole in enumerate(special.tolist()):
            yield np.frombuffer(self.whole(texts[i].as_py()), dtype="<u2") if whole else ids[ends[i] : ends[i + 1]]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as uint16; those of a null text are empty."""
        texts = pc.fill_null(texts, "")
        for a, b in slices(texts, SLICE_BYTES):
            yield from self._slice(texts.slice(a, b - a))
        pa.default_memory_pool().release_unused()


class WordEncoder(PieceEncoder):
    """For a vocabulary whose pre-tokens never hold white space; case is folded by the file's normaliser.

    Pieces lie between ASCII white space. A printable one of characters below U+0130 is in normal form and folds
    character by character, so its pre-tokens are found here; any other is encoded as a text.
    """

    find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def numbered(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        return numbered_pieces(texts, pc.ascii_split_whitespace, r"[\x1c-\x1f]", lambda t: re.split(r"[ \t\n\v\f\r]+", t), False)

    def words(self, piece: str) -> list[str] | None:
        if plain := PLAIN(piece):
            word, marks = plain.groups()
            word = shown(word.lower())
            return [word, marks] if marks else [word]
        if piece and max(piece) < "\u0130" and piece.isprintable():
            return list(map(shown, self.find(piece.lower())))
        return None


class ByteEncoder(PieceEncoder):
    """For byte-level vocabularies whose pre-tokens never cross the place before a lone blank.

    A piece stands for itself with a blank before it; the first of a text, which has none, is a one-tuple. Where all
    characters are below U+0250, so that any version of Unicode has the same classes, pre-tokens are found here.
    """

    find = regex.compile(BYTE_PATTERN).findall
    text_of = staticmethod(piece_text)

    def numbered(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        return numbered_blank_pieces(texts)

    def words(self, piece) -> list[str] | None:
        lead, text = (SHOWN[32], piece) if isinstance(piece, str) else ("", piece[0])
        if plain := PLAIN(text):
            word, marks = plain.groups()
            word = lead + shown(word)
            return [word, marks] if marks else [word]
        text = piece_text(piece)
        return list(map(shown, self.find(text))) if not text or max(text) < "\u0250" else None


def tiktoken_encoding(vocab: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks_of(vocab), special_tokens={})


_HELD: dict = {}


def held_encoder(key: tuple, make: Callable[[], PieceEncoder]) -> PieceEncoder:
    """The worker's encoder for ``key``; a worker keeps one at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what the worker holds; called by operators that hold much else."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


#: Bytes of the texts of one block, whose distinct words go to the shuffle once; a longer text is one block.
BLOCK_BYTES = 12 << 20


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, one plane after the other."""
    a = np.asarray(a, dtype="<u4")
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _bucketed(words: list[str], buckets: int) -> list[tuple[int, bytes, bytes]]:
    """A block's distinct words by bucket: (bucket, packed numbers, their compressed bytes in sorted order)."""
    encoded = [w.encode() for w in words]
    if not encoded:
        return []
    bucket = np.fromiter(map(zlib.crc32, encoded), dtype=np.int64, count=len(encoded)) % buckets
    order = np.lexsort((np.array([w[:12] for w in encoded], dtype="S12"), bucket))
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        head = _packed(np.array([len(encoded[i]) for i in part]))
        blob = zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(encoded[i] for i in part), 3)
        out.append((int(bucket[part[0]]), _packed(part), blob))
    return out


class _Block:
    """The documents of one block: its name, the pieces of its texts with their words, and all its distinct words.

    A block is named by its texts, so that a block computed again has the same name or, from changed input, another.
    """

    def __init__(self, texts: pa.Array, pattern: str) -> None:
        texts = pc.fill_null(texts, "")
        name = hashlib.sha256(pc.binary_length(texts).to_numpy().tobytes())
        for t in texts:
            name.update(t.as_buffer())
        self.name = name.hexdigest()
        self.pieces, self.k, self.cuts = numbered_blank_pieces(texts)
        find, plain = regex.compile(pattern).findall, PLAIN if pattern == BYTE_PATTERN else lambda text: None
        number: dict[str, int] = {}
        self.spelled: list[list[int]] = []
        for p in self.pieces:
            lead, text = (" ", p) if isinstance(p, str) else ("", p[0])
            if found := plain(text):
                word, marks = found.groups()
                words = (lead + word, marks) if marks else (lead + word,)
            else:
                words = find(lead + text)
            self.spelled.append([number.setdefault(w, len(number)) for w in words])
        self.words = list(number)


def _blocks(pattern: str, make):
    """Record batches that ``make`` builds from each block's ids and _Block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            for a, b in slices(texts, BLOCK_BYTES):
                yield make(ids.slice(a, b - a), _Block(texts.slice(a, b - a), pattern))

        for batch in batches:
            held.append((batch.column("doc_id"), batch.column("text")))
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    return run


def _dictionary(buckets: int):
    def make(ids: pa.Array, block: _Block) -> pa.RecordBatch:
        out = _bucketed(block.words, buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array([block.name] * len(out), pa.string()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
            names=["block", "bucket", "numbers", "words"],
        )

    return make


def _sequences(ids: pa.Array, block: _Block) -> pa.RecordBatch:
    """The places of each document's words, as numbers of its block's dictionary."""
    lengths = np.fromiter(map(len, block.spelled), dtype=np.int64, count=len(block.spelled))
    flat = np.fromiter((w for s in block.spelled for w in s), dtype=np.int64, count=int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    n = lengths[block.k]
    ends = np.concatenate(([0], np.cumsum(n)))
    places = flat[np.repeat(starts[block.k] - ends[:-1], n) + np.arange(ends[-1])]
    cuts = ends[block.cuts].tolist()
    packed = [_packed(places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([block.name] * len(ids), pa.string()), ids, pa.array(packed, pa.binary())], names=["block", "doc_id", "places"])


def _words_of(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    head = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_unpacked(raw[4 : 4 + head]), dtype=np.int64) + 4 + head
    return [raw[a:b] for a, b in zip([4 + head, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _encode_words(vocab, pattern: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "encoding" not in _HELD:
            _HELD.clear()
            _HELD["encoding"] = tiktoken_encoding(vocab.value, pattern)
        one = _HELD["encoding"].encode_ordinary
        known: dict[bytes, list[int]] = {}
        counts, ids = [], []
        for blob in pdf["words"]:
            words = _words_of(blob)
            for w in words:
                if w not in known:
                    known[w] = one(w.decode())
            found = [known[w] for w in words]
            counts.append(_packed(np.fromiter(map(len, found), dtype=np.int64, count=len(found))))
            ids.append(_packed(np.array([i for x in found for i in x], dtype=np.int64)))
        return pd.DataFrame({"block": pdf["block"], "numbers": pdf["numbers"], "counts": counts, "ids": ids})

    return run


def _reassemble(token_bytes):
    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        decode = token_bytes.value
        total = sum(len(_unpacked(n)) for n in words["numbers"])
        texts: list[bytes] = [b""] * total
        raws: list[bytes] = [b""] * total
        sizes = np.zeros(total, dtype=np.int64)
        for numbers, counts, ids in zip(words["numbers"], words["counts"], words["ids"], strict=True):
            n, ids = _unpacked(counts).astype(np.int64), _unpacked(ids).tolist()
            ends = np.cumsum(n).tolist()
            numbers = _unpacked(numbers)
            sizes[numbers] = n
            for k, a, b in zip(numbers.tolist(), [0, *ends[:-1]], ends, strict=True):
                texts[k] = ",".join(map(str, ids[a:b])).encode()
                raws[k] = b"".join([decode[i] for i in ids[a:b]])
        n_tokens, id_marks, raw_marks = [], [], []
        for blob in docs["places"]:
            seq = _unpacked(blob)
            if len(seq) and int(seq.max()) >= total:
                raise ValueError("the dictionary of a block is missing: its input changed between two reads")
            order = seq.tolist()
            n_tokens.append(int(sizes[seq].sum()))
            id_marks.append(hashlib.sha256(b",".join([texts[k] for k in order])).hexdigest())
            raw_marks.append(hashlib.sha256(b"".join([raws[k] for k in order])).hexdigest())
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_tokens": n_tokens, "ids_sha256": id_marks, "decoded_sha256": raw_marks})

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) by the ranks at ``path`` and decode the ids again, each distinct word once.

    Texts are cut into pre-tokens (the matches of ``pattern``, in their order); a block of texts sends each of its
    distinct words once to the word's bucket, where all blocks' equal words are encoded together, and keeps the
    words' places as numbers. The ids come back to the block, which puts the texts together by place and decodes
    them with the token-byte table (of fixed size, broadcast). Rows (doc_id, n_tokens, ids_sha256 of the decimal
    ids joined by commas, decoded_sha256 of the decoded bytes), one per input row. A null or empty text has no ids
    and the digests of nothing; repeated rows stay repeated; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = vocabulary(path)
    by_id = {i: b for b, i in ranks_of(vocab).items()}
    token_bytes = spark.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id) + 1)])
    shared_vocab = spark.sparkContext.broadcast(vocab)
    buckets = 4 * shuffle_parts(spark)
    # two passes over the texts cost less than a stored copy of all places
    docs = docs.select("doc_id", "text")
    cut = docs.mapInArrow(_blocks(pattern, _dictionary(buckets)), "block string, bucket int, numbers binary, words binary")
    words = cut.groupBy("bucket").applyInPandas(_encode_words(shared_vocab, pattern), "block string, numbers binary, counts binary, ids binary")
    sequences = docs.mapInArrow(_blocks(pattern, _sequences), "block string, doc_id long, places binary")
    return sequences.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(
        _reassemble(token_bytes), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's ids and of the bytes they decode to. Cases as in ``encode_decode``."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
