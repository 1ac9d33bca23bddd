from __future__ import annotations

import random

import sentencepiece

from quarryline.llm import piece_tokenizer
from quarryline.session import table
from tests.llm.helpers import LONG, SF, by_id, documents

ODD = [None, "", " ", "  two  spaces ", "\n\n a\tb", "▁ mark ▁▁", "é漢字🙂‍", "a b", "<s> </s> <unk> <0x41>", "x" * 3000, "\x00\x01", " lead", "trail ", LONG[:400_000], "<|end|>"]


def test_round_trip_and_parity(spark):
    model = piece_tokenizer.read_model()
    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = list(enumerate(ODD)) + [(50, "same"), (50, "same"), (None, "same")]
    found = piece_tokenizer.encode_pieces(documents(spark, rows, "ids n_tokens"), model)
    assert found.count() == len(rows)
    back = by_id(piece_tokenizer.decode_pieces(found, model))
    for i, row in by_id(found).items():
        text = dict(rows)[i] or ""
        assert row.n_tokens == len(row.ids)
        assert row.parity == (other.encode(text) == row.ids)
        assert row.round_trip == (other.decode(row.ids) == text) == (back[i].text == text), i
    assert all(by_id(found)[i].parity for i in range(len(ODD)) if "▁" not in (ODD[i] or ""))


def test_words_and_whole_texts_agree():
    random.seed(6)
    encoder = piece_tokenizer.Encoder(piece_tokenizer.read_model())
    assert encoder.by_word
    other = sentencepiece.SentencePieceProcessor(model_proto=piece_tokenizer.read_model())
    letters = "abcdeßéñ .,!  \n\t漢🙂09"
    for _ in range(30):
        texts = ["".join(random.choices(letters, k=random.randint(0, 80))) for _ in range(40)]
        ids, sizes, whole, same = encoder.encode(texts)
        at = 0
        for text, n in zip(texts, sizes, strict=True):
            assert ids[at : at + n].tolist() == other.encode(text)
            at += n
        assert all(whole) and all(same)


def test_query_on_the_driver_tables(spark):
    from __spark_entry__ import queries

    found = by_id(queries()["op8_sentencepiece"](spark, SF))
    other = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer.MODEL_PATH)
    for doc in table(spark, SF, "documents").collect():
        assert found[doc.doc_id].ids == other.encode(doc.text or "")
        assert found[doc.doc_id].round_trip and found[doc.doc_id].parity


def varint(value):
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def field(number, value):
    import struct

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("▁a", -4.5, 1), ("abab", -5.0, 1)]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1))
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = piece_tokenizer.Encoder(data)
    texts = ["ab", "abab ba", "a b ab", "aé b", "", "bbb aab"]
    ids, sizes, whole, same = encoder.encode(texts)
    ends = sizes.cumsum()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [other.encode(t) for t in texts]
    assert all(whole) and all(same)


def test_empty_table_and_null_ids(spark):
    model = piece_tokenizer.read_model()
    assert piece_tokenizer.encode_pieces(documents(spark, []), model).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {i: r.text for i, r in by_id(piece_tokenizer.decode_pieces(rows, model)).items()} == {1: None, 2: ""}


def test_another_normaliser_is_noticed():
    from tokenizers import normalizers

    encoder = piece_tokenizer.Encoder(piece_tokenizer.read_model())
    encoder.normalizer = normalizers.Sequence([normalizers.Lowercase(), encoder.normalizer])
    *_, whole, same = encoder.encode(["A Stone", "a stone"])
    assert (whole, same) == ([False, True], [False, True])


def test_another_decoder_is_noticed():
    from tokenizers import decoders

    encoder = piece_tokenizer.Encoder(piece_tokenizer.read_model())
    encoder.tokenizer.decoder = decoders.Sequence([decoders.Replace("▁", "_"), decoders.Fuse()])
    *_, whole, same = encoder.encode(["a stone"])
    assert (whole, same) == ([False], [True])


def test_the_cache_is_bounded_by_its_characters(monkeypatch):
    monkeypatch.setattr(piece_tokenizer, "CACHE_CHARS", 1000)
    encoder = piece_tokenizer.Encoder(piece_tokenizer.read_model())
    for i in range(5):
        *_, whole, same = encoder.encode([f"{i}" * 900, "short"])
        assert all(whole) and all(same) and len(encoder.known) <= 4


def test_new_words_are_encoded_a_bounded_number_of_characters_at_once(monkeypatch):
    encoder, seen = piece_tokenizer.Encoder(piece_tokenizer.read_model()), []
    line = encoder._line
    monkeypatch.setattr(encoder, "_line", lambda words: seen.append(sum(map(len, words))) or line(words))
    text = " ".join(f"word{i:06d}" for i in range(20_000))
    ids, _, whole, same = encoder.encode([text])
    assert whole == same == [True] and ids.tolist() == encoder.other.encode(text)
    assert len(seen) > 1 and max(seen) < 50_000
