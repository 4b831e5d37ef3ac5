"""Example search over every caller whose id is divisible by 100."""

import random

from lodestrata.plans import code


def test_every_caller_divisible_by_100(spark, tmp_path):
    rng = random.Random(3)
    callers = [100 * k for k in range(1, 31)] + rng.sample([i for i in range(1, 3000) if i % 100], 60)
    names = {m: {f"f{rng.randrange(25)}" for _ in range(rng.randint(1, 6))} for m in callers}
    rows = [(k, m, "call", n, None) for k, (m, n) in enumerate((m, n) for m in callers for n in sorted(names[m]))]
    spark.createDataFrame(rows, "ref_id long, from_symbol long, kind string, name string, loaded_at timestamp").write.parquet(f"{tmp_path}/code_refs.parquet")
    got = {(r["query_id"], r["symbol_id"], r["context"]) for r in code.example_context(spark, str(tmp_path)).collect()}
    want = set()
    for q in callers:
        if q % 100 == 0:
            near = [(round(len(names[q] & names[m]) / len(names[q] | names[m]), 6), m) for m in callers if m != q and names[q] & names[m]]
            want |= {(q, m, s) for s, m in sorted(near, key=lambda x: (-x[0], x[1]))[:10]}
    assert len({q for q, _, _ in want}) == 30 and got == want
