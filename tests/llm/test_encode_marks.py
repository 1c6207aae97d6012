import numpy as np

from driftwood.llm.encode import Encoder, public_path


def test_a_mark_after_a_letter_that_is_taken_apart():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder(public_path(name))
        texts = ["é İ,", "a İ. b", "ॐ क़, x", "É. 12, ñ!"]
        assert enc.encode(texts) == [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_new_pieces_among_pieces_without_ids_and_repeated_ones():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = Encoder(public_path(name))
        for texts in (["new1  old new1\n\n new2, ", "", " a b"], ["new1 new3  new1 \t new2. new3"]):
            want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
            assert enc.encode(texts) == want
