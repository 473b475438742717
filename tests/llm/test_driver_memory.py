"""What the driver holds while it learns."""

import tracemalloc

import numpy as np

from tidemark.llm import toxicity


def corpus(texts: int, words: int, seed: int = 5) -> tuple[list[bytes], np.ndarray]:
    rng = np.random.default_rng(seed)
    known = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(6, 12, 4000)])
    return [" ".join(known[rng.integers(0, len(known), words)]).encode() for _ in range(texts)], np.arange(texts) % 2


def test_toxicity_learns_in_memory_of_few_times_its_texts():
    texts, labels = corpus(1500, 400)
    tracemalloc.start()
    try:
        toxicity.Toxicity(texts, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 4 * sum(map(len, texts)), most / sum(map(len, texts))


def test_terms_are_counted_once_for_near_copies_of_a_class():
    texts, labels = corpus(40, 60)
    texts += [texts[0] + b" extra", texts[1] + b" further", b"", texts[0]]
    labels = np.append(labels, [0, 1, 1, 1])
    terms = toxicity.Terms(texts, labels)
    groups: dict[tuple[int, int, int], set[bytes]] = {}
    copy_of = {40: 0, 41: 1, 43: 0}
    for i, (text, y) in enumerate(zip(texts, labels.tolist(), strict=True)):
        if text:
            groups.setdefault((int(terms.fold[i]), y, copy_of.get(i, i)), set()).update(text.split())
    for k in range(toxicity.FOLDS):
        for y in (0, 1):
            own = [g for (f, label, _), g in groups.items() if (f, label) == (k, y)]
            assert terms.n[k, y] == len(own)
            assert {w: c for w, c in zip(terms.words, terms.per_word[k, y].tolist(), strict=True) if c} == {w: sum(w in g for g in own) for w in set().union(*own)}
            begun = [{w[:n] for w in g for n in range(4, min(9, len(w)))} for g in own]
            assert {w: c for w, c in zip(terms.starts, terms.per_start[k, y].tolist(), strict=True) if c} == {w: sum(w in g for g in begun) for w in set().union(*begun)}
