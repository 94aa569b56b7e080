"""The trigram index is as large as what is asked of it."""

import numpy as np

from waystone.llm.secrets import RULES, Index, grams_of, trigram_query


def test_the_index_is_small_and_finds_what_it_is_asked():
    asked = sorted(set().union(*(grams_of(trigram_query(r.pattern)) for r in RULES)))
    index = Index(asked)
    assert index.table.nbytes < 1 << 20
    texts = [b"", b"ab", b"no", *(b"x" + g.upper() + b"\xff" for g in asked), *(g[:2] for g in asked), b"".join(asked)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    index.build(buf, off)
    for g in asked:
        assert index.find(("gram", g)).tolist() == [i for i, t in enumerate(texts) if g in t.lower()]
