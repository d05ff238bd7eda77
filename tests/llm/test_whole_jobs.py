from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from lexitab.llm import license_scan, mixing


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_stage_drops_planted_near_copies(spark, small):
    """Edited copies of similarity 0.8 to 0.9 are several bits apart; those of less than 0.8 stay."""
    rnd = random.Random(8)
    rows, near, far = [], set(), set()
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(150, 400))]
        rows.append((10 * k, " ".join(words)))
        edited = list(words)
        for n in range(1, len(words) // 20):
            edited[(37 * n) % len(words)] = f"new{n}"
            similarity = jaccard(rows[-1][1], " ".join(edited))
            if similarity < 0.88:
                break
        rows.append((10 * k + 1, " ".join(edited)))
        (near if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else far).add(10 * k + 1)
        rows.append((10 * k + 2, " ".join(words[len(words) // 3 :] + edited[: len(words) // 6])))
        far.add(10 * k + 2)
    crowd = [f"c{rnd.randrange(5000)}" for _ in range(300)]
    for k in range(100):  # one group beyond CROWD
        rows.append((5000 + k, " ".join([*crowd[:k], f"only{k}", *crowd[k + 1 :]])))
    assert len(near) > 50 and all(jaccard(a[1], b[1]) < 0.8 for a in rows for b in rows if a[0] // 10 == b[0] // 10 < 500 and b[0] in far and a[0] != b[0])
    rows += [(9000, None), (9001, " "), (9002, "one two"), (9003, "One\n two"), (None, "one two"), (9002, "one two"), (9004, "one three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = corpus_pipeline.simhash_dedup(spark, df, small)
    assert kept.columns == df.columns
    want = {10 * k for k in range(60)} | far | {5000, 9000, 9002, 9004}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert corpus_pipeline.simhash_dedup(spark, df.limit(0), small).count() == 0


def test_documents_of_kept_domains_get_a_copy(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.5, 0.4, 0.4], 3000)
    tokens = rng.integers(1, 500, 3000)
    df = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p))], "key long, n_tokens long, posterior array<double>")
    fit = mixing.fit_rates(df, ["a", "b", "c"], {"a": 0.8, "b": 0.15, "c": 0.05}, keep=["a", "b"])
    rate = fit.rate(F.col("posterior")).alias("rate")
    rows = df.select("n_tokens", "posterior", rate, mixing.copies(rate, F.col("key")).alias("copies")).collect()
    clean = [r for r in rows if np.argmax(r["posterior"]) < 2]
    assert len(clean) > 1000 and all(r["rate"] >= 1 and r["copies"] >= 1 for r in clean)
    assert any(r["copies"] == 0 for r in rows)
    reached = sum(r["rate"] * r["n_tokens"] * np.array(r["posterior"]) for r in rows)
    assert np.allclose(reached, fit.reached, rtol=1e-6)


def test_each_tag_of_a_line_is_parsed():
    found = license_scan.scan(b"SPDX-License-Identifier: MIT b SPDX-License-Identifier: Apache-2.0 OR SPDX-License-Identifier: GPL-2.0-only\nmore words")
    assert found["expressions"] == ["mit", "apache-2.0", "gpl-2.0-only"] and found["permitted"] is False
    assert found["labels"] == "apache-2.0,gpl-2.0-only,mit" and found["score"] == 1 - 0.5**6
    assert license_scan.scan(b"SPDX-License-Identifier: SPDX-License-Identifier: MIT")["expressions"] == ["mit"]
