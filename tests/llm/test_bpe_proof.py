"""The proof that vocabulary strings encode to themselves must be able to fail."""

import json

from factloom.llm import bpe, tokens


def test_unreachable_strings_are_not_proven(tmp_path):
    letters = bpe.byte_letters()
    vocab = {letters[b]: b for b in range(256)} | {"bc": 256, "ab": 257, "abc": 258}
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"] = []
    spec["model"] |= {"vocab": vocab, "merges": ["b c", "a b", "ab c"]}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    model = bpe.ByteBpe(str(path))
    want = model.library.encode("abc", add_special_tokens=False).ids
    assert want == [ord("a"), 256]
    assert b"abc" not in model.whole_tokens()
    assert model.encode("abc").tolist() == want and list(tokens.count_tokens(model, ["abc"])) == [2]
