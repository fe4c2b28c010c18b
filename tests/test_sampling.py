"""Seeded samples against plain loops."""

import hashlib
import random

from pairloom import constants as K
from pairloom.plans import sampling as P


def five_grams(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(x, y):
    both = five_grams(x) | five_grams(y)
    return bool(both) and len(five_grams(x) & five_grams(y)) / len(both) >= K.STRATUM_NEAR


def test_every_member_of_a_class_counts_as_near_copy(spark, tmp_path):
    """texts of the same tokens were one class, and only the member with the smallest id was compared with others."""
    rng = random.Random(3)
    rows = []
    for i in range(0, 240, 4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        other = words[:38] + [f"w{rng.randrange(10**6)}"]
        body = lambda w: "\n".join(" ".join(w[k::6]) for k in range(6))
        line = "\n".join(body(words).split("\n")[:5]) + " " + body(words).split("\n")[5]
        # A text, its copy in capitals, one with fewer lines, and a near copy; then short texts without a shingle.
        rows += [(i, body(words)), (i + 1, body(words).upper()), (i + 2, line), (i + 3, body(other))]
    rows += [(i, "\n" * 6 + ("same" if i % 2 else "SAME") + str(i) * (i % 3)) for i in range(300, 312)]
    docs = [(i, text, "en" if i % 8 < 4 else "de", f"s{i}", len(text)) for i, text in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for lang in ("en", "de"):
        seen = set()
        for low, high in K.STRATA:
            chosen = []
            mine = [d for d in docs if d[2] == lang and low <= d[1].count("\n") + 1 <= high]
            for i, text, *_ in sorted(mine, key=lambda d: (hashlib.sha256(f"{P.SEED}|{d[0]}".encode()).hexdigest(), d[0])):
                if len(chosen) < K.STRATUM_SIZE and text not in seen and not any(near(text, t) for _, t in chosen):
                    chosen.append((i, text))
                    seen.add(text)
            want |= {i for i, _ in chosen}
    got = [r.id for r in P.stratified_sample(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
