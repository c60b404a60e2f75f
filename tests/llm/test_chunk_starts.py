import random

from quillon.llm import chunkdedup


def test_equal_texts_have_equal_chunks_after_any_text():
    rnd = random.Random(9)
    text = lambda n: bytes(rnd.choice(b"abcdefghij klmn") for _ in range(n))
    texts = [text(n) for n in [*range(40), *[rnd.randint(100, 900) for _ in range(60)]]] + [b"y" * 5000, b"", b"\xc3\xa9" * 3000]

    def chunks(batch, which):
        doc, start, end, digest = chunkdedup.split(batch)
        return [x[doc == which].tolist() for x in (start, end, digest)]

    alone = [chunks([t], 0) for t in texts]
    order = list(range(len(texts)))
    for _ in range(3):
        rnd.shuffle(order)
        doc, start, end, digest = chunkdedup.split([texts[i] for i in order])
        for k, i in enumerate(order):
            assert [x[doc == k].tolist() for x in (start, end, digest)] == alone[i], i
