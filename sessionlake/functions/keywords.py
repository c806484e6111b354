"""Rule sets of any number of keywords: one pass over a text finds all of them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _automaton(words: Sequence[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, word)
    out.make_automaton()
    return out


def rule_hits(text: Column, rules: Sequence[tuple], default: str | None = None) -> Column:
    """struct(score, rule) of the upper-cased text for rules (weight, name, keywords).

    ``score`` sums the weights of all keywords that the text holds, each once
    per rule that lists it; ``rule`` is the name of the first rule with a
    keyword in it, else ``default``. Both are what ``keyword_score`` and
    ``first_rule`` give; the plan and the time per text do not grow with the
    number of keywords, which a Python worker puts into one automaton. An
    empty keyword is in every text; a null text holds none.
    """
    score: dict[str, int] = {}
    first: dict[str, int] = {}
    for n, (weight, _, words) in enumerate(rules):
        for word in words:
            score[word] = score.get(word, 0) + weight
            first.setdefault(word, n)
    always = [""] if "" in score else []
    words, names, kept = [w for w in score if w], [name for _, name, _ in rules], []

    @F.pandas_udf("score long, rule string")
    def hits(texts: pd.Series) -> pd.DataFrame:
        if words and not kept:
            kept.append(_automaton(words))
        out = []
        for value in texts:
            found = set() if value is None else {word for _, word in kept[0].iter(value)} if words else set()
            found.update(always if value is not None else ())
            rule = min((first[w] for w in found), default=None)
            out.append((sum(score[w] for w in found), default if rule is None else names[rule]))
        return pd.DataFrame(out, columns=["score", "rule"]).astype({"score": "int64", "rule": object})

    return hits(F.upper(text))
