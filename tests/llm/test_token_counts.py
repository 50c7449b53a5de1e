import random

import public_tokenizers
import sentencepiece
from textgate.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    c, sp = token_counts.PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    letters = "ab ▁<>s/0x1é中文\U0001f600\n\t Thequick​\x00_"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["a" * 20_000, " " * 3000, "ab" * 9000, "</s>", "<s>", "<unk>", "<0x0A>", ""]
    for t in texts:
        assert c.count(t) == len(sp.encode(t)), t


def test_odd_rows(odd, odd_rows, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, MODEL).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 4096) for r in odd_rows]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(none, MODEL).collect() == []
