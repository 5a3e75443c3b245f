import math
import re
from collections import Counter

import numpy as np
import pytest

from tablecensus.llm.quality import RULES, estimate, judged, with_statistics
from tablecensus.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(repeated),
    )


@pytest.mark.parametrize("vocabulary", [3, 12, 60])
def test_statistics(docs, odd, prose, vocabulary):
    texts = [*odd, *[prose(i, n, vocabulary) for i, n in enumerate([1, 2, 3, 4, 5, 6, 50, 400])]]
    texts += ["a b c a b c", "a a a a", "a a a", "x\ny\nx\n \n \nX", "# | <>\x0b\x0c&&\r\n%$*", "x\r\nx\nx\r\n", "the\x85end 　 ok"]
    df = docs(*texts, clash=True)
    out = with_statistics(df)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}
    assert set(df.columns) <= set(out.columns)


def more_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return (
        sum(any(c in "#*$%&|<>" for c in w) for w in words), sum(c in marks for c in text),
        sum("A" <= c <= "Z" for c in text), len(set(words)), sum(bool(WORD.search(line)) for line in text.split("\n")),
    )


def test_more_statistics(docs, odd, prose):
    texts = [*odd, prose(1, 300, 50), "Ab AB aB #1 x|y <z> !\"'()+,-./:;=?@[\\]^_`{}~ ÄÖ é", "a\nB\n\nC c C"]
    rows = with_statistics(docs(*texts)).collect()
    names = ("n_symbol_words", "n_marks", "n_capitals", "n_distinct", "n_lines")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {i: more_statistics(t) for i, t in enumerate(texts)}


def test_long_text(docs, prose):
    text = prose(1, 40_000, 30)
    row = with_statistics(docs(text)).first()
    assert (row.n_words, row.n_repeat_words) == (statistics(text)[0], statistics(text)[4])


def texts(prose):
    good = [prose(i, 200, 5000) for i in range(60)]
    symbols = [" ".join(w + "%%%" for w in prose(100 + i, 150, 5000).split()) for i in range(5)]
    lines = ["\n".join([prose(200 + i, 30, 5000)] * 8) for i in range(4)]
    short = [prose(300 + i, 20, 5000) for i in range(4)]
    return good, symbols, lines, short


def test_faults_go_and_clean_texts_stay(docs, prose):
    kinds = texts(prose)
    rows = judged(docs(*[t for kind in kinds for t in kind])).collect()
    kept = {r.doc_id: r.kept for r in rows}
    at = 0
    for kind, stays in zip(kinds, (True, False, False, False)):
        assert {kept[i] for i in range(at, at + len(kind))} == {stays}
        at += len(kind)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1


def votes(text):
    """The votes of all rules on one text, computed apart."""
    words, chars, symbols, dups, repeated = statistics(text)
    symbol_words, marks, capitals, distinct, lines = more_statistics(text)
    numbers = {
        "length": (words, 1), "word_length": (chars, words), "symbols": (symbols, words), "symbol_words": (symbol_words, words),
        "marks": (marks, chars), "capitals": (capitals, chars), "dup_lines": (dups, lines), "repetition": (repeated, words),
        "variety": (distinct, math.sqrt(words)),
    }
    out = []
    for rule, (_, good, bad) in RULES.items():
        over, under = numbers[rule]
        inside = [under and all((low if low is not None else -math.inf) <= over / under <= (high if high is not None else math.inf)
                                for low, high in [limits]) for limits in (good, bad)]
        out.append(1 if inside[0] and inside[1] else 0 if inside[1] else -1)
    return out


def posteriors(texts, rounds=2000):
    """Expectation-maximisation text by text, on matrices of texts and rules."""
    v = np.array([votes(t) for t in texts])
    voted, for_good, for_bad = v != 0, v == 1, v == -1
    share, on_good, on_bad = 0.85, np.full(len(RULES), 0.97), np.full(len(RULES), 0.2)
    for _ in range(rounds):
        like_good = np.prod(np.where(for_good, on_good, np.where(for_bad, 1 - on_good, 1)), axis=1) * share
        like_bad = np.prod(np.where(for_good, 1 - on_bad, np.where(for_bad, on_bad, 1)), axis=1) * (1 - share)
        p = like_good / (like_good + like_bad)
        held = 0.02 * len(texts)
        share = (p.sum() + held * 0.85) / (len(texts) + held)
        on_good = ((for_good * p[:, None]).sum(0) + held * 0.97) / ((voted * p[:, None]).sum(0) + held)
        on_bad = ((for_bad * (1 - p)[:, None]).sum(0) + held * 0.2) / ((voted * (1 - p)[:, None]).sum(0) + held)
    return p


def test_posterior_against_brute_force(docs, odd, prose):
    all_texts = [*odd, *[t for kind in texts(prose) for t in kind]]
    all_texts += [" ".join(w.upper() for w in prose(400 + i, 90, 5000).split()) for i in range(3)]
    all_texts += [prose(500 + i, 70 + i, 20) for i in range(5)]
    want = posteriors(all_texts)
    rows = judged(docs(*all_texts)).collect()
    for r in rows:
        assert r.p_good == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_one_weak_vote_does_not_reject(spark, docs, prose, tmp_path):
    """Repeated lines alone are outvoted, symbols, which several rules see, are not."""
    good, symbols, _, _ = texts(prose)
    refrain = ["\n".join([*(prose(600 + 10 * i + j, 25, 5000) for j in range(8)), *["so it goes"] * 6]) for i in range(3)]
    rows = [*good, *symbols, *refrain]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect()}
    for i in range(len(good) + len(symbols), len(rows)):
        assert votes(rows[i]).count(-1) == 1 and not out[i].base_failed and out[i].kept
    for i in range(len(good), len(good) + len(symbols)):
        assert votes(rows[i]).count(-1) > 1 and not out[i].base_failed and not out[i].kept
    for i, text in enumerate(rows):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(text)


def test_estimation():
    rules = len(RULES)
    all_good = (1,) * rules
    one_fault = (-1, *[1] * (rules - 1))
    # a rule that mostly contradicts all others is found to be wrong on good texts
    model = estimate({all_good: 900, one_fault: 30, (-1,) * rules: 70})
    assert model.posterior(all_good) > 0.9 and model.posterior((-1,) * rules) < 0.01
    assert model.posterior(one_fault) > 0.5 and model.right[0][1] < model.right[1][1]
    assert model.weight(0, -1) > model.weight(1, -1)
    # the same vote counts once others come along with it
    two, alone = (-1, -1, *[1] * (rules - 2)), (0, -1, *[1] * (rules - 2))
    assert estimate({all_good: 900, two: 100}).posterior(two) < 0.5 < estimate({all_good: 990, alone: 10}).posterior(alone)
    assert model.posterior((0,) * rules) == pytest.approx(model.good)
    scaled = estimate({all_good: 9000, one_fault: 300, (-1,) * rules: 700})
    assert scaled.good == pytest.approx(model.good) and scaled.posterior(one_fault) == pytest.approx(model.posterior(one_fault))
    assert estimate({}).posterior(()) == pytest.approx(0.85)
    assert 0 < estimate({all_good: 5}).posterior(all_good) < 1


def test_odd_rows_and_empty_table(docs, odd):
    df = docs(*enumerate(odd), (None, None), (3, "again"), (3, "again"), clash=True)
    out = judged(df)
    assert out.count() == len(odd) + 3 and not any(r.kept for r in out.collect())
    empty = judged(df.limit(0))
    assert empty.count() == 0 and set(out.columns) == set(empty.columns)
    assert judged(df, carry=["doc_id"]).columns[0] == "doc_id"


def test_no_python_on_executors(docs):
    plan = judged(docs("a b c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
