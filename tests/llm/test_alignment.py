"""Tokenizer alignment against plain loops over the libraries' tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partita.llm import alignment

FILES = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces"), (6, "x\ny\n\nz \n w"), (7, "<|endoftext|> <s> </s> a"), (8, "tab\there"), (9, "a▁b"), (10, "café é ﬁ 　x y"), (11, "你好 \U0001f600 ok"),
    (12, "don't it's 123 45.67, (x) [y]!? ..."), (13, "a" * 5000), (14, "trail "), (14, "trail "), (None, "null id"), (15, "\r\nx\r"), (16, "\x00 nul \x1c x"), (17, "x.\ny,z"), (18, "\n"), (19, "\nlead"), (20, "﻿bom"), (21, "Ⅷ ² ½ 1st"), (22, "long words " * 3000),
]


def plain(rows):
    a_side, b_side = Tokenizer.from_file(FILES.tokenizer), sentencepiece.SentencePieceProcessor(model_file=FILES.pieces)
    a_side.no_truncation()
    a_side.no_padding()
    a_side.encode_special_tokens = True
    letter = alignment._byte_of_letter()
    out, links, seen, top = [], [], Counter(), defaultdict(int)
    for doc, x in rows:
        a, b = (a_side.encode(" " + x, add_special_tokens=False).ids, b_side.encode(x)) if x else ([], [])
        sides = [bytes(map(letter.__getitem__, a_side.id_to_token(i))) for i in a], [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or any(b"".join(s) != (" " + x).encode() for s in sides):
            out.append((doc, 0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for s in sides:
            at, own = 0, []
            for token in s:
                own.append((at, at + len(token)))
                at += len(token)
            spans.append(own)
        text, i, j, groups, own = [], 0, 0, 0, []
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            i0, j0 = i, j
            while i < len(a) and spans[0][i][1] <= cut:
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                j += 1
            own += [(a[u], b[v]) for u in range(i0, i) for v in range(j0, j) if spans[0][u][0] < spans[1][v][1] and spans[1][v][0] < spans[0][u][1]]
            text.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            groups += 1
        out.append((doc, len(a), len(b), groups, len(own), hashlib.sha256(";".join(text).encode()).hexdigest()))
        links.append(own)
        seen.update(set(own))
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    return sorted(((*o[:5], sum(seen[p] == top[p[0]] for p in own), sum(seen[p] for p in own), o[5]) for o, own in zip(out, links)), key=str)


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_equals_plain_loops(spark, data, most, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = ODD + [tuple(r) for r in docs]
    own = alignment.aligned_slices
    monkeypatch.setattr(alignment, "aligned_slices", lambda docs, v: own(docs, v, most))
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    assert sorted(map(tuple, alignment.align_tokenizers(df, FILES, 32_000).collect()), key=str) == plain(rows)
    assert alignment.align_tokenizers(df.limit(0), FILES, 32_000).count() == 0


def test_cut_texts_give_the_libraries_ids():
    a_side, b_side = Tokenizer.from_file(FILES.tokenizer), sentencepiece.SentencePieceProcessor(model_file=FILES.pieces)
    a_side.encode_special_tokens = True
    encoder, texts = alignment.PairEncoder(FILES, limit=5), [x for _, x in ODD if x]
    (a, at), (b, bt) = encoder.encode(texts)
    assert encoder.apart
    assert [a[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [a_side.encode(" " + x, add_special_tokens=False).ids for x in texts]
    assert [b[i:j].tolist() for i, j in zip(bt[:-1], bt[1:])] == b_side.encode(texts)
