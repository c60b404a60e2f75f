import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from quillon import catalog
from quillon.operators import cpd

SF = "/root/testdata/sf0.001"


def test_gradients_and_products_take_one_pass_over_pairs_that_are_not_kept(spark, monkeypatch):
    passes, own = [], cpd.matrix_sum
    monkeypatch.setattr(cpd, "matrix_sum", lambda *a, **k: (passes.append(1), own(*a, **k))[1])
    kept, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: (kept.append(df.columns), persist(df, *a))[1])
    got = {r["factor"]: (r["gradient"], r["hessian"]) for r in catalog.QUERIES["cpd_grad_hvp_norms"](spark, SF).collect()}
    assert len(passes) == 1 and not any("fh" in c for c in kept)
    f, p = catalog._factors(), catalog._pairs(spark, SF, ["train"])
    for b in "whc":
        g, h = own(p, lambda x, y, r, b=b: cpd.block_gradient(x, y, r, f, b)), own(p, lambda x, y, r, b=b: cpd.block_hessian(x, y, r, f, b, getattr(f, b)))
        assert np.allclose(got[b], [np.linalg.norm(g), np.linalg.norm(h)], atol=2e-3)
