"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over bytes cuts every text where its last bytes say so, hence equal passages of
different documents fall into equal chunks. A chunk that occurs more than once is encoded once, by
the document where it occurs first, and lent to all others; the rest is encoded where it stands.
The ids of a chunk hold between its first and its last white space: no token crosses ASCII white
space, so there the chunk's own ids and those of the whole text agree. The run of text around each
joint of two chunks is encoded again, taking in chunk after chunk until it ends at white space on
both sides.
"""

from __future__ import annotations

import os
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, map_slices
from agentrace.llm.packing import ROW, packed_texts, rows_of, unpacked
from agentrace.llm.registry import query, table

#: Steps of the doubling that makes a rolling hash of 16 bytes, and bits that must be zero at a cut.
STEPS, CUT_BITS = (1, 2, 4, 8), 9
#: Where no content cuts (long repeats), a chunk ends after so many bytes.
LONGEST = 16384
MULTIPLIER = 0x9E3779B1
#: The memory of a worker's word memo, in bytes of words and ids.
MEMO_BYTES = 64 << 20
#: Compressed bytes of the texts that are split, encoded and decoded at a time.
PACKED_BYTES = 1 << 18


@lru_cache(1)
def byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32)


def chunks(text: bytes) -> list[bytes]:
    """The text in content-defined chunks; a cut never splits a character."""
    n = len(text)
    if n <= 2 * sum(STEPS):
        return [text] if text else []
    data = np.frombuffer(text, np.uint8)
    rolled = byte_values()[data]
    for step in STEPS:
        rolled[step:] += rolled[:-step] * np.uint32(pow(MULTIPLIER, step, 1 << 32))
    at = np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = np.concatenate(([0], at[at > sum(STEPS)], [n]))
    if (gaps := np.diff(at)).max() > LONGEST:
        at = np.unique(
            np.concatenate([np.arange(a, a + g, LONGEST) for a, g in zip(at, gaps)] + [[n]])
        )
    for _ in range(3):
        inner = at[at < n]
        at = np.concatenate((inner + (data[inner] & 0xC0 == 0x80), [n]))
    at = np.unique(at)
    return [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def body(chunk: bytes) -> tuple[int, int]:
    """Where the first white space of a chunk is and where its last one ends; (-1, -1) if none."""
    first = 0 if chunk[:1].isspace() else len(chunk.split(None, 1)[0]) if chunk else 0
    if first == len(chunk):
        return -1, -1
    return first, len(chunk) if chunk[-1:].isspace() else len(chunk) - len(chunk.rsplit(None, 1)[-1])


class Encoder:
    """A tokenizer with a memo of words; one per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Lent ids travel in the smallest width that the vocabulary needs.
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[bytes, bytes] = {}
        self.held = 0
        #: A special token that ends a word as the end of a text does, if there is one.
        self.stop = next(
            (
                (t.content, i)
                for i, t in self.tokenizer.get_added_tokens_decoder().items()
                if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)
            ),
            None,
        )
        #: Without a decoder, a text is its tokens with spaces between them.
        names = self.tokenizer.get_vocab() if self.tokenizer.decoder is None else {}
        self.names = {i: token for token, i in names.items()}

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each by itself; special tokens between them spare a call per word."""
        texts = [w.decode() for w in words]
        if self.stop and len(texts) > 1 and not any(self.stop[0] in t for t in texts):
            whole = self.tokenizer.encode_batch_fast([self.stop[0].join(texts)], add_special_tokens=False)
            ids = np.array(whole[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.stop[1])
            if len(ends) == len(texts) - 1:
                raw, at = ids.tobytes(), [0, *(4 * ends + 4).tolist(), 4 * len(ids) + 4]
                return [raw[a : b - 4] for a, b in zip(at, at[1:])]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words between white space."""
        memo = self.memo
        if new := list(set(words).difference(memo)):
            ids = self.encoded(new)
            memo.update(zip(new, ids))
            self.held += sum(map(len, new)) + sum(map(len, ids)) + 150 * len(new)
        out = list(map(memo.__getitem__, words))
        if self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        rows = [np.frombuffer(i, "<u4").tolist() for i in ids]
        if names := self.names:
            return [" ".join([names[i] for i in row if i in names]) for row in rows]
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget(path: str) -> None:
    """At a task's end its words go; the tokenizer stays for the worker's next task."""
    encoder(path).memo, encoder(path).held = {}, 0


def joined(text: bytes, lent: dict[int, bytes], words: list[bytes]) -> list[bytes | int]:
    """A text as pieces in order: lent ids, and counts of words appended to ``words``."""
    pieces: list[bytes | int] = []

    def own(found):
        words.extend(found)
        pieces.append(len(found))

    run = b""
    for i, chunk in enumerate(chunks(text)):
        first, last = body(chunk)
        if first < 0:  # the joint's repair takes in the whole chunk
            run += chunk
            continue
        own((run + chunk[:first]).split())
        if i in lent:
            pieces.append(lent[i])
        else:
            own(chunk[first:last].split())
        run = chunk[last:]
    own(run.split())
    return pieces


def chunk_places(source: DataFrame) -> DataFrame:
    """One row per chunk of every text: its digest, its document and its number there."""
    schema = fields(source, *ROW, digests="array<binary>")

    def cut(batch):
        return {
            **{name: batch.column(name) for name in ROW},
            "digests": [
                [blake2b(c, digest_size=16).digest() for c in chunks(t.encode())]
                for t in batch.column("text").to_pylist()
            ],
        }

    return map_slices(source, cut, schema, "text").select(
        *ROW, F.posexplode("digests").alias("pos", "digest")
    )


def lent_chunks(source: DataFrame, packed: DataFrame, tokenizer: str, done=None) -> DataFrame:
    """Ids of every chunk with several places: ``digest, ids``; each is encoded once."""
    place = F.struct(*ROW, "pos")
    shared = (
        chunk_places(source)
        .groupBy("digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
    )
    owners = (
        shared.select("first.*", "digest")
        .groupBy(*ROW)
        .agg(F.collect_list(F.struct("pos", "digest")).alias("own"))
    )
    schema = fields(source, digests="array<binary>", ids="array<binary>")

    def publish(batch):
        coder, digests, ids = encoder(tokenizer), [], []
        for text, own in zip(unpacked(batch), batch.column("own").to_pylist()):
            cut, words, counts = chunks(text), [], []
            for place in own:
                first, last = body(chunk := cut[place["pos"]])
                words += (found := chunk[first:last].split() if first >= 0 else [])
                counts.append(len(found))
            coded = iter(np.frombuffer(w, "<u4") for w in coder.words(words))
            narrow = lambda n: [next(coded).astype(coder.width).tobytes() for _ in range(n)]
            digests.append([place["digest"] for place in own])
            ids.append([b"".join(narrow(n)) for n in counts])
        return {"digests": digests, "ids": ids}

    published = map_slices(packed.join(owners, [*ROW]), publish, schema, "packed", done)
    return (
        published.select(F.explode(F.arrays_zip("digests", "ids")).alias("c"))
        .select(F.col("c.digests").alias("digest"), F.col("c.ids").alias("ids"))
        .groupBy("digest")
        .agg(F.first("ids").alias("ids"))
    )


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    decode: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_words: bool = True,
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids``; ids are little-endian 32-bit integers.

    With ``decode`` there is also ``decoded``, the text that these ids decode to. A worker's memo
    of words serves its next task too, unless ``keep_words`` is off: that costs a quarter more time
    and leaves the memory to what else runs in the session.

    ``tokenizer`` is the path of a file of the tokenizers library whose pre-tokenizer never joins
    text across ASCII white space. Special tokens that stand in a text are recognised, none is
    added, nothing is truncated or padded. Null and empty texts have no ids; repeated rows give
    equal rows; an empty table gives none. Texts are shuffled once, packed, for both joins;
    chunk counts are combined in each task, and the join that lends a hot chunk's ids asks for one
    more key than the lent side is dealt by, so that adaptive execution can split it. What meets
    in one row is the chunks of one document.
    """
    source = rows_of(docs, id_col, text_col)
    packed = packed_texts(source)
    done = None if keep_words else partial(forget, tokenizer)
    salt = F.xxhash64("digest").alias("salt")
    lent = (
        chunk_places(source)
        .withColumn("salt", salt)
        .join(lent_chunks(source, packed, tokenizer, done).withColumn("salt", salt), ["digest", "salt"])
        .groupBy(*ROW)
        .agg(F.collect_list(F.struct("pos", "ids")).alias("lent"))
    )
    more = {"decoded": "string"} if decode else {}
    schema = fields(source, "doc_id", n_tokens="bigint", ids="binary", **more)

    def assemble(batch):
        coder, words, rows = encoder(tokenizer), [], []
        for text, own in zip(unpacked(batch), batch.column("lent").to_pylist()):
            borrowed = {place["pos"]: place["ids"] for place in own or ()}
            rows.append(joined(text, borrowed, words))
        coded, ids = coder.words(words), []
        at = 0
        for pieces in rows:
            parts = []
            for piece in pieces:
                if isinstance(piece, int):
                    parts += coded[at : at + piece]
                    at += piece
                else:
                    parts.append(np.frombuffer(piece, coder.width).astype("<u4").tobytes())
            ids.append(b"".join(parts))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids": ids,
            **({"decoded": coder.decode(ids)} if decode else {}),
        }

    return map_slices(packed.join(lent, [*ROW], "left"), assemble, schema, "packed", done, PACKED_BYTES)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of ``encoded`` and the text that its ids decode to; null ids decode to ''."""
    encoded = encoded.withColumn("ids", F.coalesce("ids", F.lit(b"")))
    schema = fields(encoded, *encoded.columns, decoded="string")

    def decode(batch):
        columns = {name: batch.column(name) for name in encoded_names}
        columns["decoded"] = encoder(tokenizer).decode(batch.column("ids").to_pylist())
        return columns

    encoded_names = encoded.columns
    return map_slices(encoded, decode, schema, "ids")


def round_trip_digests(docs: DataFrame, tokenizer: str, keep_words: bool = True) -> DataFrame:
    """``doc_id, n_tokens`` and SHA-256 digests of the ids and of the text they decode to."""
    return encode_documents(docs, tokenizer, decode=True, keep_words=keep_words).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"), default_tokenizer())
