"""Fusion of two readers' totals as one ordered CASE over prepared columns.

fuse(df) reads icr, icr_conf, rapid, rapid_conf, ink, registered and adds votes, conf, used_rapid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scalars import register

#: (condition, which total, confidence), first hit wins. `both` needs two plausible readings.
DECISIONS: list[tuple[str, str, str]] = [
    ("both AND r = i AND i > 0", "i", "least(0.93D, (ic + rc) / 2 + 0.06D)"),
    ("both AND i > 0 AND noisy", "i", "least(ic, 0.70D)"),
    ("i_ok AND i >= 100 AND r_ok AND (endswith(si, sr) OR startswith(si, sr)) AND li > lr", "i", "ic"),
    ("i_ok AND i >= 100 AND r_ok AND r BETWEEN 1 AND 99", "r", "least(0.88D, rc)"),
    ("i_ok AND i >= 100 AND r_ok AND lr >= 3", "i", "ic"),
    ("i_ok AND i >= 100", "0", "least(ic, 0.40D)"),
    ("r_ok AND r > 0 AND i = 0 AND ink >= 0.010D AND rc >= 0.75D AND lr <= 2", "r", "least(0.88D, greatest(rc, 0.70D))"),
    ("r_ok AND r > 0 AND i = 0 AND lr = 3", "0", "greatest(ic, 0.55D)"),
    ("r_ok AND r > 0 AND i = 0 AND lr = 4 AND rc >= 0.85D", "r", "least(0.88D, rc)"),
    ("differ AND endswith(si, sr) AND li > lr", "i", "ic"),
    ("differ AND lr = li + 1 AND li >= 2 AND startswith(sr, si) AND r % 10 = 1 AND rc >= 0.64D", "r", "least(0.88D, rc)"),
    ("differ AND lr = 3 AND li = 2 AND i % 10 = 0 AND r % 10 <> 0 AND rc >= 0.64D", "r % 100", "least(0.88D, rc)"),
    ("differ AND lr = li + 1 AND li >= 2", "i", "least(ic, 0.70D)"),
    ("differ AND lr = 2 AND li = 1 AND rc >= 0.64D", "r", "least(0.88D, rc)"),
    ("differ AND lr = 3 AND li = 1", "i", "least(ic, 0.70D)"),
    ("differ AND lr > li AND rc >= 0.85D", "r", "least(0.88D, rc)"),
    ("differ AND i = 9 AND r IN (3, 4, 7)", "i", "ic"),
    ("differ AND lr = li AND li <= 2 AND rc >= 0.85D", "r", "least(0.88D, rc)"),
    ("differ AND lr = li AND i % 10 = 0 AND r % 10 <> 0 AND rc >= 0.64D", "r", "least(0.88D, rc)"),
    ("differ", "i", "ic"),
    ("r_ok AND r > 0 AND rc >= 0.85D AND NOT i_ok", "r", "least(0.88D, rc)"),
    ("i_ok AND (i > 0 OR NOT r_ok)", "i", "ic"),
    ("r_ok", "r", "least(0.70D, greatest(rc, 0.45D))"),
]


def fuse(df: DataFrame) -> DataFrame:
    register(df.sparkSession)
    names = df.columns
    d = df.select("*", F.expr("CAST(icr AS INT) AS i"), F.expr("CAST(icr_conf AS DOUBLE) AS ic"), F.expr("coalesce(IF(rapid > 0, peel_rule(rapid), NULL), rapid) AS r"), F.expr("CAST(rapid_conf AS DOUBLE) AS rc"), F.expr("nullif(registered, 0) AS reg"))
    d = d.withColumns({"i_ok": F.expr("coalesce(i BETWEEN 0 AND least(9999, coalesce(reg, 9999)), false)"), "r_ok": F.expr("coalesce(r BETWEEN 0 AND least(9999, coalesce(reg, 9999)) AND rc >= 0.55D AND NOT dash_noise(r), false)"), "si": F.expr("string(i)"), "sr": F.expr("coalesce(string(r), '')")})
    d = d.withColumns({"li": F.length("si"), "lr": F.length("sr"), "both": F.expr("i_ok AND r_ok"), "noisy": F.expr("coalesce(dash_inflated(r, i) OR extra_digit(r, i), false)"), "differ": F.expr("i_ok AND r_ok AND r <> i AND i > 0")})
    cases = " ".join(f"WHEN {c} THEN named_struct('votes', CAST({v} AS INT), 'conf', {p}, 'used_rapid', {str(v[0] == 'r').lower()})" for c, v, p in DECISIONS)
    out = d.withColumn("__f", F.expr(f"CASE {cases} ELSE named_struct('votes', 0, 'conf', greatest(ic, 0.55D), 'used_rapid', false) END"))
    return out.select(*names, "__f.votes", "__f.conf", "__f.used_rapid")
