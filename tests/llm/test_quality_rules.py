import re
from collections import Counter

from stintwise.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def test_measures_agree_with_plain_python(docs_of, edge_docs):
    texts = [
        (11, "a b c d e x a b c d e y a b c d e"),
        (12, "# same line\n# same line\n\n# same line\nother $|$"),
        (13, "a a a a a a"),
        (14, "x\x0by\x0cz w\x1cv"),
        (15, " ".join(f"the word{i} of and" for i in range(40))),
    ]
    for docs in (docs_of(texts), edge_docs):
        for r in quality_rules.apply_rules(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            want = plain(r["text"])
            assert {k: r[k] for k in want} == want


def test_verdicts(docs_of):
    good = " ".join(f"the reader{i} of book{i} and" for i in range(20))
    rows = [(1, good), (2, good.upper()), (3, " ".join(f"w{i}*** %%{i}" for i in range(40))), (4, "spam " * 30)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs_of(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_every_row_gets_a_verdict(edge_docs, no_docs):
    rows = quality_rules.apply_rules(edge_docs).collect()
    assert len(rows) == 9 and all(r["kept"] is not None and r["base_failed"] is not None for r in rows)
    assert quality_rules.apply_rules(no_docs).count() == 0
