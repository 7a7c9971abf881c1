"""Token ids against two public libraries."""

import random

import pyarrow as pa
import pytest

from lodestrand.llm.tokenize import VOCABULARY, Encoder, _chunks, count_tokens, encode_corpus, read_vocabulary

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_vocabulary(VOCABULARY))


def encode(encoder, texts):
    out = []
    for data, offsets in _chunks(pa.array(texts, pa.string())):
        counts, ids = encoder.encode(data, offsets, False)
        at = 0
        for n in counts.tolist():
            out.append(ids[at : at + n].tolist())
            at += n
    return out


def samples():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "　", "\xa0", "中", "文字", "é", "é", "1", "２", "Ⅱ", "!", "...", "🙂", "а", "\x1c", "\x85", "<|endoftext|>", "A", "'S", "\r\n", "한", "Hello", "​"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    out += ["".join(map(chr, rng.sample(points, 25))) for _ in range(500)]
    return [*out, "", None, "a" * 5000, "的" * 3000, " " * 999 + "x", "ab" * 3000, "'s's't", "x" + " " * 3, "long text. " * 200_000]


def test_ids_equal_both_libraries(encoder):
    import tiktoken
    from tokenizers import Tokenizer

    texts = samples()
    mine = encode(encoder, texts)
    one = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    two = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    two.encode_special_tokens = True
    assert mine == [one.encode_ordinary(t or "") for t in texts]
    assert mine[:3500] == [e.ids for e in two.encode_batch([t or "" for t in texts[:3500]], add_special_tokens=False)]


def test_round_trip(encoder):
    back = {v: k for k, v in encoder.ranks.items()}
    for t, ids in zip(samples(), encode(encoder, samples()), strict=True):
        assert b"".join(back[i] for i in ids).decode() == (t or "")


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello 世界", "z"), (3, "Hello 世界", "z"), (None, "a", None)], "doc_id bigint, text string, ids string")
    rows = [(r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text").collect()]
    assert rows[:2] == [(1, []), (2, [])] and rows[2] == rows[3] and len(rows[2][1]) > 2 and rows[4][0] is None
    assert [r.tokens for r in count_tokens(df, ["doc_id"], "text").collect()] == [len(i) for _, i in rows]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_merge_of_long_fragments_equals_the_plain_one(encoder):
    rng = random.Random(5)
    for _ in range(30):
        piece = bytes(rng.choice(b"abcde ") for _ in range(300))
        assert encoder._merge_long(piece) == encoder.merge(piece)


def test_workers_keep_few_vocabularies_by_content():
    from lodestrand.llm import tokenize as tok

    tok._encoders.clear()
    files = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
    made = [tok._encoder(f, lambda f=f: tok.read_vocabulary(f)) for f in files]
    assert tok._encoder(files[0], None) is made[0] and tok._encoder(files[1], None) is made[1]
    tok._encoder("third", lambda: tok.read_vocabulary(files[0]))
    assert list(tok._encoders) == [files[1], "third"]


def test_text_comes_back(spark):
    from lodestrand.llm import tokenize as tok

    texts = ["", "a b", "中文 текст 🙂", None, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in tok.decode_corpus(tok.encode_corpus(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
