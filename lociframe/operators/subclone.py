"""Sub-clonal copy-number states from raw (fractional) allele copies: a pure projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import _validate as check

STATES = ("A", "B", "C", "D")


def subclone_cn(seg: DataFrame, a_raw: str = "nAraw", b_raw: str = "nBraw", min_subclonal: float = 0.01) -> DataFrame:
    """``seg`` with fracA-fracD, nMaj_A-nMaj_D and nMin_A-nMin_D.

    Each allele's raw copies lie between two integers, which gives the
    fractions of two states; fractions within ``min_subclonal`` of 0 or 1 are
    snapped.  If the alleles' fractions agree or one allele is clonal there are
    two states (A the larger), else four, whose fractions are products.
    """
    check.columns(seg, [a_raw, b_raw], "seg")

    def snapped(x: Column) -> Column:
        return F.when(x < min_subclonal, 0.0).when(x > 1 - min_subclonal, 1.0).otherwise(x)

    d = seg.withColumns({"_j1": F.floor(a_raw).cast("double"), "_j2": F.ceil(a_raw).cast("double"), "_n1": F.floor(b_raw).cast("double"), "_n2": F.ceil(b_raw).cast("double")})
    j, n = F.col("_j2") - F.col(a_raw), F.col("_n2") - F.col(b_raw)
    d = d.withColumns({"_fj1": snapped(j), "_fj2": snapped(1 - j), "_fn1": snapped(n), "_fn2": snapped(1 - n)})
    j1, j2, n1, n2 = (F.col(c) for c in ("_fj1", "_fj2", "_fn1", "_fn2"))
    J1, J2, N1, N2 = (F.col(c) for c in ("_j1", "_j2", "_n1", "_n2"))
    two = (j1 == n1) | (j1 == n2) | j1.isin(0.0, 1.0) | n1.isin(0.0, 1.0)
    ja, jb, na, nb = F.greatest(j1, j2), F.least(j1, j2), F.greatest(n1, n2), F.least(n1, n2)
    a_is_j1, a_is_n1 = ja == j1, na == n1
    maj_a, min_a = F.when(a_is_j1, J1).otherwise(J2), F.when(a_is_n1, N1).otherwise(N2)
    maj_b, min_b = F.when(a_is_j1, J2).otherwise(J1), F.when(a_is_n1, N2).otherwise(N1)
    frac_a = F.when(na == 1, ja).when(ja == 1, na).otherwise(ja)
    frac_b = F.when(na == 1, jb).when(ja == 1, nb).otherwise(jb)
    four = ~two
    fa, fc = j1 * n1, j2 * n2
    pick = lambda t, f=None: F.when(two, t).when(four, f) if f is not None else F.when(two, t)
    out = d.withColumns(
        {
            "fracA": pick(frac_a, fa),
            "fracB": pick(frac_b, j1 - fa),
            "fracC": F.when(four, fc),
            "fracD": F.when(four, j2 - fc),
            "nMaj_A": pick(maj_a, J1),
            "nMaj_B": pick(F.when(ja == 1, maj_a).otherwise(maj_b), J1),
            "nMaj_C": F.when(four, J2),
            "nMaj_D": F.when(four, J2),
            "nMin_A": pick(min_a, N1),
            "nMin_B": pick(F.when(na == 1, min_a).otherwise(min_b), N2),
            "nMin_C": F.when(four, N2),
            "nMin_D": F.when(four, N1),
        }
    )
    return out.drop("_j1", "_j2", "_n1", "_n2", "_fj1", "_fj2", "_fn1", "_fn2")
