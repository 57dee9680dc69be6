"""Delta scores with annotated sites: the sites come to the records by bins, before the scores do."""

import random

from strandline.operators import selection


def test_masked_deltas(spark):
    rng = random.Random(6)
    records = [(i, rng.choice(["1", "2", None]), rng.randrange(1, 60), "A", "G") for i in range(40)] + [(40, "1", None, "A", "G")]
    scores = [(i, a, o, rng.random(), rng.random()) for i in range(41) for a in ("ref", "alt") for o in range(-5, 6)]
    mask = [(c, p, k) for c in ("1", "2", None) for p in range(-3, 70) for k in ("donor", "acceptor", "other") if rng.random() < 0.3]
    r = spark.createDataFrame(records, "variant long, chrom string, position long, ref_allele string, alt_allele string")
    s = spark.createDataFrame(scores, "variant long, allele string, offset int, donor double, acceptor double")
    m = spark.createDataFrame(mask + mask[:20], "chrom string, position long, splice_type string")
    known = {x for x in mask if x[0] is not None}
    true = {}
    for i, chrom, p, _, _ in records:
        best = {}
        for o in range(-5, 6):
            of = {a: next(x[3:] for x in scores if x[:3] == (i, a, o)) for a in ("ref", "alt")}
            for k, kind in enumerate(("donor", "acceptor")):
                d = of["alt"][k] - of["ref"][k]
                there = chrom is not None and p is not None and (chrom, p + o, kind) in known
                d = 0.0 if (there and d > 0) or (not there and d < 0) else d
                for name, size in (("gain", max(0.0, d)), ("loss", max(0.0, -d))):
                    best[f"{kind}_{name}"] = max(best.get(f"{kind}_{name}", (-1.0, 0)), (size, -o))
        true[i] = best
    got = selection.record_deltas(r, s, 5, m)
    rows = got.collect()
    assert len(rows) == 41
    for x in rows:
        for name, (size, o) in true[x.variant].items():
            assert (x[name], x[f"{name}_at"]) == (size, -o), (x.variant, name)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Generate explode(array(struct" not in plan
