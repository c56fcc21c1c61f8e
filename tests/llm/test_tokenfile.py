import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries, tokenfile


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_against_whole_texts(spark, sf, texts, whole):
    got = {r.doc_id: r for r in queries.op5_token_files(spark, sf).collect()}
    at = 0
    for d in sorted(texts):
        ids = np.array([*whole(texts[d]), 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert len(got) == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t\x0b\x85  aé'sΣ1<|endoftext|>"))), max_size=60))
def test_words_equal_whole(text):
    encode = tokenfile.WordEncoder(queries.tokenizer_path(), np.dtype("<u2"))
    whole = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode((text + " " + text).encode())[: 2 * len(whole)], "<u2").tolist() == whole


PROBES = ["The quick  brown fox, it's 12 o'clock.\n\nNew line\tand tab", " leading and trailing ", "ÉTÉ à la plage ΣΑΣ ß", "<|endoftext|> and <|ENDOFTEXT|>", "x" * 500, "a.b,c. d, 3.5km!", ""]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(spark, tmp_path, name):
    """Ids by default are those of whole texts, for tokenizers that split words apart and for others."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(PROBES)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokenfile.token_files(df, path, 1, f"file://{tmp_path}/{name}").collect()}
    for k, text in enumerate(PROBES):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(ids)), text


def test_what_can_be_encoded_by_words():
    encoder = lambda name: tokenfile.WordEncoder(queries.tokenizer_path(name), np.dtype("<u2"))
    word, byte = encoder("word_bpe_49k.json"), encoder("byte_bpe_50k.json")
    assert word.by_words and word.by_letters and not byte.by_words and not byte.by_letters
    assert tokenfile.separable({"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "normalizer": {"type": "Lowercase"}}) == (True, False)
    assert tokenfile.separable({"model": {"type": "BPE"}, "pre_tokenizer": None, "normalizer": None}) == (False, False)
    assert tokenfile.separable({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "normalizer": {"type": "Prepend", "prepend": "_"}}) == (False, False)


def test_round_trip_and_random_access(spark, odd, tmp_path, whole):
    folder = f"file://{tmp_path}/t"
    manifest = [tuple(r) for r in tokenfile.write_tokens(odd, queries.tokenizer_path(), 1, folder, seq_len=16, rows=4).collect()]
    assert sum(m[2] for m in manifest) == odd.count()
    flat = []
    for _, file, _, n in sorted(manifest):
        own = tokenfile.TokenFile(folder, file)
        ids, mask = zip(*[own.sequence(k) for k in range(-(-n // 16))])
        ids, mask = np.concatenate(ids), np.concatenate(mask)
        assert mask.sum() == n and not mask[n:].any()
        flat += ids[:n].tolist()
        first, again = own.batch(0), own.data.get_batch(0).column(0).values.to_numpy(zero_copy_only=True)
        assert len(again) == 64 or own.data.num_record_batches == 1
        assert (first == again).all()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert flat == [x for r in rows for x in [*whole(r.text), 1]]


def test_empty(spark, none, tmp_path):
    assert tokenfile.token_files(none, queries.tokenizer_path(), 1, f"file://{tmp_path}/e").count() == 0
