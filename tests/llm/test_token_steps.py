"""Encoding with a tokenizer whose words do not stand for themselves."""

import public_tokenizers
import pytest
from cases import odd_documents
from tokenizers import Tokenizer

from rankfield.llm.token_records import encoder


@pytest.mark.parametrize(("name", "by_word"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_equal_the_tokenizer_whatever_its_steps(name, by_word):
    path = public_tokenizers.path(name)
    own, plain = encoder(path), Tokenizer.from_file(path)
    texts = [r[1] for r in odd_documents()] + ["Two  spaces\n\nand CAPS", "naïve café"]
    assert own.by_word == by_word
    assert [x.tolist() for x in own.encode(texts, 2)] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
