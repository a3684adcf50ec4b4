import numpy as np

from tidewright.llm import packing
from tidewright.llm.queries import tokenizer_file


def test_special_tokens_in_texts_equal_the_file_at_its_defaults():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_file())
    texts = [
        "hello <|endoftext|> world", "a<|endoftext|>b", "A<|ENDOFTEXT|>b <|EndOfText|>", "x <|startoftext|><|endoftext|>. y", "<|endoftext|>it's don<|endoftext|>'t",
        "a\x00<|endoftext|>\x00b", "<|endoftext|> !!!<|endoftext|>!!", "<|endoftext|", "", "<|endoftext|>", "e<|startoftext|>\u0301 \u65e5\u672c<|endoftext|>",
    ]
    for own in (texts, texts[::-1]):
        found = packing.WordTokenizer(tokenizer_file()).encode([t.encode() for t in own])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [[*fresh.encode(t, add_special_tokens=False).ids, 0] for t in own]
