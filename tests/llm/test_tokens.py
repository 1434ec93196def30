import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtrail.llm import piece_codec, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    (1, None), (2, ""), (3, "a  b"), (None, "null id"), (4, "x" * 700), (5, "ab " * 300), (6, "a <|endoftext|> b" * 60), (7, " " * 900), (8, "word\n\n  x '" * 99),
    (9, "don't 漢字　 é" * 50), (9, "don't 漢字　 é" * 50), (10, "▁ <s> <0x0A> \x00 ﬁ"), (11, "🤦🏼‍♂️ 的 ½"), (12, "a\x1cb \x1f\x85 c\u3000d\v e\x1c " * 40),
]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("chunk,overlap", [(64, 2), (200, 16), (32768, 256)])
def test_token_count(frame, chunk, overlap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(frame(TEXTS), path, chunk_chars=chunk, overlap_chars=overlap).collect()]
    n = lambda x: len(t.encode(x or "", add_special_tokens=False))
    assert ordered(got) == ordered([(i, len((x or "").encode()), n(x), n(x) > 512) for i, x in TEXTS])


def test_token_count_encodes_long_texts_whole_if_boundaries_are_not_proven(frame):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert token_count.proven(public_tokenizers.path("byte_bpe_50k.json")) and not token_count.proven(path)
    got = [(r.doc_id, r.n_tokens) for r in token_count.count_tokens(frame(TEXTS), path, chunk_chars=64, overlap_chars=2).collect()]
    assert ordered(got) == ordered([(i, len(t.encode(x or "", add_special_tokens=False))) for i, x in TEXTS])


def test_token_count_empty(empty):
    assert token_count.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    return library(), piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁abcdeilnorstu\n\té漢字🤦.,'0123ABC\x00　<s>x_-=/\"（")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_codec_equals_the_library(both, text):
    model, own = both
    ids = model.encode(text, add_eos=True)
    assert own.encode(text) == (" ".join(map(str, ids)), model.decode(ids))


@pytest.mark.parametrize("text", ["a" * 500, " " * 999, "=" * 64, "internationalization " * 50, "的" * 100, "x" * 20_000, "ab" * 3000 + " c"])
def test_codec_on_long_units(both, text):
    model, own = both
    ids = model.encode(text, add_eos=True)
    assert own.encode(text) == (" ".join(map(str, ids)), model.decode(ids))


def test_encode_pieces(frame, empty):
    path, model = public_tokenizers.path("piece_bpe_32k.model"), library()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, x in TEXTS:
        ids = model.encode(x or "", add_eos=True)
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    got = piece_codec.encode_pieces(frame(TEXTS), path, texts_too=True).collect()
    assert ordered([tuple(r)[:4] for r in got]) == ordered(expected)
    assert {r.doc_id: r.decoded for r in got}[11] == "🤦🏼‍♂️ 的 ½"
    assert piece_codec.encode_pieces(empty, path).collect() == []
