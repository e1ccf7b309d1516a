"""Token alignment against a plain version with pointers."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, awkward_texts, empty, prose, rows_of, SCHEMA

from agentrace.llm import alignment


def plain(texts):
    """What the operator must return, text by text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    json_file, model_file = alignment.default_tokenizers()
    one, two = Tokenizer.from_file(json_file), SentencePieceProcessor(model_file=model_file)
    one.encode_special_tokens = True
    stand_in, names = alignment.byte_of_character(), {i: t for t, i in one.get_vocab().items()}
    rows, count = [], Counter()
    for text in texts:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = two.encode(text)
            bytes_a = [bytes(stand_in[c] for c in names[i]) for i in a]
            pieces = [two.id_to_piece(i) for i in b]
            bytes_b = [
                bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in zip(b, pieces)
            ]
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                a = b = []
        links, groups, group, i, j = [], [], ([], []), 0, 0
        end_a = np.cumsum([len(x) for x in bytes_a]).tolist() if a else []
        end_b = np.cumsum([len(x) for x in bytes_b]).tolist() if a else []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = end_a[i], end_b[j]
            if x <= y:
                group[0].append(a[i])
            if y <= x:
                group[1].append(b[j])
            if x == y:
                groups.append(group)
                group = ([], [])
            i, j = i + (x <= y), j + (y <= x)
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
        count.update(links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (na, nb, ng, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha)
        for na, nb, ng, links, sha in rows
    ], count, most


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts():
    strange = [" lead", "two  spaces", "tab\tnew\n\nline", "▁ is taken for a space", "<0x41> <s> </s> <unk>", " " * 700 + "x",
               " ﻿　wide", "ﬁ ligature ½", "न मस्ते 🤷🏽‍♀️", "\u0000", "a" * 3000]
    return awkward_texts() + strange + [prose(i, 40 + 13 * i, 900) for i in range(60)]


@pytest.mark.parametrize("frequent", [0, 7, 1 << 18])
def test_alignment_is_that_of_two_pointers(spark, frequent):
    rows = rows_of(texts(), first=0)
    docs = spark.createDataFrame(rows, SCHEMA)
    expected, count, most = plain(texts())
    found, pairs = alignment.aligned_tokens(docs, *alignment.default_tokenizers(), frequent=frequent)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == expected[r.doc_id], r
    assert {((r.a, r.b), r.n, r.best) for r in pairs.collect()} == {(p, n, n == most[p[1]]) for p, n in count.items()}


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lanes_change_nothing(lane):
    one, two = alignment.sides(*alignment.default_tokenizers())
    base = alignment.align([t or "" for t in texts()], one, two, 1 << 30)
    cut = alignment.align([t or "" for t in texts()], one, two, lane)
    for name in ("links_a", "links_b", "cuts_a", "cuts_b"):
        assert getattr(base, name).tolist() == getattr(cut, name).tolist()


def test_links_cover_the_text(spark):
    docs = spark.createDataFrame(rows_of(["Some plain text, with parts.", None, "x" * 50]), SCHEMA)
    links = alignment.token_links(docs, *alignment.default_tokenizers()).collect()
    assert {r.doc_id for r in links} == {1, 3}
    mine = sorted((r for r in links if r.doc_id == 1), key=lambda r: r.link)
    assert [r.link for r in mine] == list(range(len(mine))) and mine[0].start == 0
    assert all(x.stop == y.start for x, y in zip(mine, mine[1:])) and mine[-1].stop == len(" Some plain text, with parts.")
    assert mine[-1].group == len({r.group for r in mine}) - 1


def test_alignment_of_awkward_rows(spark):
    docs = awkward(spark)
    found, _ = alignment.aligned_tokens(docs, *alignment.default_tokenizers())
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r.doc_id) for r in docs.collect())
    found, pairs = alignment.aligned_tokens(empty(spark), *alignment.default_tokenizers())
    assert found.count() == 0 and pairs.count() == 0


def test_spelling_is_compared_at_once_for_many_texts(monkeypatch):
    class Coder:
        bytes = [b"a", b"bc", "é".encode(), b"", b" "]
        encode = None

    def never(self, i):
        raise AssertionError("the bytes of tokens are looked up one by one")

    monkeypatch.setattr(alignment, "COMPARED", 2)
    side = alignment.Side(Coder)
    side.bytes = type("Bytes", (list,), {"__getitem__": never})(side.bytes)
    texts = [" abc", " bca", "", " é", " ab", " aa", " ", " aaaa"]
    ids = [[4, 0, 1], [4, 0, 1], [], [4, 2, 3], [4, 0], [4, 0, 0], [3, 4, 3], [4, 0, 1, 0]]
    parts = [t.encode() for t in texts]
    found = side.spells(
        [np.array(x, np.uint32) for x in ids], np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)))
    )
    assert found.tolist() == [True, False, True, True, False, True, True, False]


def test_long_white_space_is_found_at_any_place():
    for lead in range(130):
        assert alignment.has_long_space("x" * lead + " \n" * 256 + "x")
        assert not alignment.has_long_space("x" * lead + " " * 511 + "x")
        assert not alignment.has_long_space(" x" * 600)
