import zlib
from collections import defaultdict

import numpy as np
import odd
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from surtido.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, length):
    wanted = sorted((str(r.doc_id), tuple(ids_of(r.text))) for r in docs.collect())
    pieces = packing.pack(docs, PATH, length).collect()
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        sequences[p.sequence_id].append((p.offset, p.length, p.padded_to))
    total = sum(len(x) for _, x in wanted)
    assert sorted(sequences) == list(range(-(-total // length)))
    for k, rows in sequences.items():
        at = 0
        for offset, n, _ in sorted(rows):
            assert offset == at
            at += n
        full = k < total // length
        assert at == (length if full else total % length)
        assert {x for _, _, x in rows} == {length if full else 1 << (at - 1).bit_length()}
    # Pieces in the order of the sequences give the documents back.
    found, held = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(held)
        held += np.frombuffer(p.ids, "<u4").tolist()
        if len(held) == p.doc_tokens:
            found.append((str(p.doc_id), tuple(held)))
            held = []
    assert sorted(found) == wanted


@pytest.mark.parametrize("length", [2048, 64])
def test_every_id_in_one_place(spark, length):
    check(odd.documents(spark).repartition(3), length)


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_very_long_blanks(spark, blank):
    check(odd.documents(spark, ["word" + blank * 2_000_000 + "word", "the next text"]), 2048)


def test_small_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").limit(60), 2048)


def test_other_files_go_to_the_library():
    encode = packing.byte_level_encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).encode("The end", add_special_tokens=False).ids
    assert encode("The end").tolist() == want


def test_empty_table(spark):
    assert packing.pack(odd.documents(spark).limit(0), PATH).collect() == []
