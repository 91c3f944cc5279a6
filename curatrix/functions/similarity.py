"""Text similarity in 0..1, case-insensitive; 0 when either side is missing.

The default is the normalised Levenshtein ratio, a built-in that stays in generated code, also over sorted tokens.  The
indel ratio, its best window and Jaro-Winkler run as Arrow batches for those who ask for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    ratio = 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(_present(a, b), ratio).otherwise(0.0)


def token_sort(c: Column) -> Column:
    """Lower-cased words in order, so that word order does not matter."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return levenshtein_ratio(token_sort(a), token_sort(b))


def _jaro_winkler(s: str, t: str) -> float:
    if not s or not t:
        return 0.0
    if s == t:
        return 1.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    used = [False] * len(t)
    hits = []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if m == 0:
        return 0.0
    other = [t[j] for j in range(len(t)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(s[:4], t[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a.fillna("").str.lower(), b.fillna("").str.lower())
    return pd.Series([_jaro_winkler(x, y) for x, y in pairs], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    batch = F.pandas_udf(_jaro_winkler_batch, "double")
    return batch(a, b)


def _places(s: str) -> dict[str, int]:
    """For each character the places where ``s`` has it, as bits."""
    out: dict[str, int] = {}
    for i, ch in enumerate(s):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def _common(places: dict[str, int], n: int, t: str) -> int:
    """Length of the longest common subsequence of ``t`` and the text of length ``n`` behind ``places``, a row of the table per step."""
    full = (1 << n) - 1
    row = full
    for ch in t:
        met = row & places.get(ch, 0)
        row = (row + met | row - met) & full
    return n - row.bit_count()


def _indel(s: str, t: str) -> float:
    return 2 * _common(_places(s), len(s), t) / (len(s) + len(t)) if s and t else 0.0


def _partial(s: str, t: str) -> float:
    """The highest indel ratio of the shorter text and any window of its length in the longer one."""
    if not s or not t:
        return 0.0
    s, t = sorted((s, t), key=len)
    if s in t:
        return 1.0
    places, n = _places(s), len(s)
    if n == len(t):
        return _common(places, n, t) / n
    return max(_common(places, n, t[i : i + n]) for i in range(len(t) - n + 1)) / n


def _pairwise(one):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a.fillna("").str.lower(), b.fillna("").str.lower())
        return pd.Series([one(x, y) for x, y in pairs], dtype="float64")

    return F.pandas_udf(batch, "double")


def indel_ratio(a: Column, b: Column) -> Column:
    """1 - (insertions and deletions between the texts) / (both lengths), that is 2 * longest common subsequence / both lengths."""
    return _pairwise(_indel)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """Indel ratio of the shorter text with its best window in the longer one; the work grows with the product of the lengths."""
    return _pairwise(_partial)(a, b)


ALGORITHMS = {"ratio": levenshtein_ratio, "token_sort": token_sort_ratio, "jaro_winkler": jaro_winkler, "indel": indel_ratio, "partial": partial_ratio}


def similarity(a: Column, b: Column, algorithm: str = "ratio") -> Column:
    return ALGORITHMS[algorithm](a, b)
