"""The engine's results in plain SQL, for an independent engine to check against.

Steps are named queries; query() puts a final select after the steps it needs.
"""

from __future__ import annotations

import re

from ..functions.causal import CENTRE, MIDDLE, TAIL

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> str:
    STEPS[name] = sql
    return name


def query(final: str, materialized: bool = True) -> str:
    """final, after every step that it or its steps name."""
    done: list[str] = []

    def need(sql: str) -> None:
        for word in re.findall(r"\b(?:from|join)\s+([a-z]\w*)", sql):
            if word in STEPS and word not in done:
                need(STEPS[word])
                if word not in done:
                    done.append(word)

    need(final)
    if not done:
        return final
    how = "materialized " if materialized else ""
    return "with " + ",\n".join(f"{n} as {how}({STEPS[n]})" for n in done) + "\n" + final


def r6(x: str, name: str | None = None) -> str:
    """x to six decimals, without negative zero."""
    return f"round({x}, 6) + 0.0 as {name or x}"


def ratio(q: str) -> str:
    return f"(({q}) / (1 + ({q})))"


def ev(n: str, mean: str, ref: str, sd: str) -> str:
    return ratio(f"sqrt({n}) * abs({mean} - {ref}) / {sd}")


P = "partition by id"
CUM = "(partition by id order by t rows between unbounded preceding and current row)"

step("li", "select l_suppkey as id, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 as k, l_extendedprice as value, count(*) over (partition by l_suppkey) as n from lineitem")
step("li2", "select *, floor(n * 0.6::double)::int as h from li")
step("li3", "select *, floor(0.7::double * h)::int as cut, case when k < h then 1 else 2 end as period, case when k >= h then (k - h)::int end as t, case when id % 2 = 0 then -1 else ((id * 37) % 200)::int end as tau_index from li2")
step("series", "select id, k, value, n, h, cut, period, t, tau_index, case when period = 2 then (tau_index >= 0 and t >= tau_index)::int end as target from li3")

step("ev1", "select user_id as id, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as k, count(*) over (partition by user_id) as n from events")
step("ev2", "select *, floor(n * 0.6::double)::int as h from ev1")
step("eseries", "select *, floor(0.7::double * h)::int as cut, case when k < h then 1 else 2 end as period, case when k >= h then (k - h)::int end as t from ev2")


def detector_steps(source: str, tag: str) -> None:
    """Steps <tag>_on (standardised online rows) and <tag>_<detector>."""
    labels = ", tau_index, target" if source == "series" else ""
    step(f"{tag}_h1", f"select *, coalesce(avg(case when period = 1 then value end) over ({P}), 0.0) as mu, greatest(coalesce(stddev_samp(case when period = 1 then value end) over ({P}), 1.0), 1e-8) as sd from {source}")
    step(f"{tag}_h2", f"select *, (value - mu) / sd as z from {tag}_h1")
    step(
        f"{tag}_h3",
        f"""select *, coalesce(var_samp(case when period = 1 then z end) over ({P}), 1.0) as ref_var,
        coalesce(avg(case when period = 1 then abs(z) end) over ({P}), 0.0) as ref_abs, greatest(coalesce(stddev_samp(case when period = 1 then abs(z) end) over ({P}), 1.0), 1e-8) as ref_abs_sd,
        coalesce(avg(case when period = 1 then z * z end) over ({P}), 0.0) as ref_sq, greatest(coalesce(stddev_samp(case when period = 1 then z * z end) over ({P}), 1.0), 1e-8) as ref_sq_sd
        from {tag}_h2""",
    )
    step(f"{tag}_on", f"select * from {tag}_h3 where period = 2")
    key = f"id, t{labels}"
    step(f"{tag}_ew", f"select *, 0.05::double * pow(0.95::double, t) * sum((value - mu) * pow(0.95::double, -t)) over {CUM} as d, (1 - pow(0.95::double, t + 1)) / (1 - 0.95::double) as ne from {tag}_on")
    step(f"{tag}_ewma", f"select {key}, tanh(abs(d / greatest(sd / sqrt(greatest(ne, 1.0)), 1e-8)) / 3) as score from {tag}_ew")
    step(f"{tag}_cu", f"select *, sum(z - 0.5::double) over {CUM} as u, sum(-z - 0.5::double) over {CUM} as l from {tag}_on")
    low = lambda c: f"{c} - least(0.0, min({c}) over {CUM})"
    step(f"{tag}_cusum", f"select {key}, {ratio('q')} as score from (select *, greatest({low('u')}, {low('l')}) as q from {tag}_cu)")
    step(f"{tag}_ph1", f"select *, z - avg(z) over {CUM} as c from {tag}_on")
    step(f"{tag}_ph2", f"select *, sum(c - 0.05::double) over {CUM} as u, sum(-c - 0.05::double) over {CUM} as l from {tag}_ph1")
    step(f"{tag}_page_hinkley", f"select {key}, {ratio('q')} as score from (select *, greatest({low('u')}, {low('l')}) as q from {tag}_ph2)")
    step(f"{tag}_running_mean", f"select {key}, {ratio('q')} as score from (select *, sqrt(t + 1) * abs(avg(z) over {CUM}) as q from {tag}_on)")
    step(f"{tag}_variance_ratio", f"select {key}, {ratio('q')} as score from (select *, case when t > 0 then abs(ln(greatest(var_samp(z) over {CUM}, 1e-12) / greatest(ref_var, 1e-12))) else 0.0 end as q from {tag}_on)")
    step(f"{tag}_absolute", f"select {key}, {ev('t + 1', 'm', 'ref_abs', 'ref_abs_sd')} as score from (select *, avg(abs(z)) over {CUM} as m from {tag}_on)")
    step(f"{tag}_squared", f"select {key}, {ev('t + 1', 'm', 'ref_sq', 'ref_sq_sd')} as score from (select *, avg(z * z) over {CUM} as m from {tag}_on)")
    if labels:
        step(f"{tag}_constant", f"select {key}, 0.5 as score from {tag}_on")
        step(f"{tag}_age_only", f"select {key}, (t + 1) / (t + 2)::double as score from {tag}_on")
        step(f"{tag}_perfect", f"select {key}, target::double as score from {tag}_on")
        step(f"{tag}_reversed", f"select {key}, 1 - target::double as score from {tag}_on")


detector_steps("series", "d")
detector_steps("eseries", "x")

FIT, REF, ON = "k < cut", "(period = 1 and k >= cut)", "period = 2"


def over(agg: str, cond: str, x: str) -> str:
    return f"{agg}(case when {cond} then {x} end) over ({P})"


def sd(cond: str, x: str) -> str:
    return f"greatest({over('stddev_samp', cond, x)}, 1e-8)"


def bank(name: str, source: str, value: str, out: str, windows=(32, 128, 256), ref: str = REF) -> str:
    """Step name: source with out1.., and out, their mean."""
    step(f"{name}_bank1", f"select *, {value} as bv, {over('avg', ref, value)} as rm, {sd(ref, value)} as rs, case when {ON} then {value} end as ov from {source}")
    frame = lambda w: f"(partition by id order by k rows between {'unbounded' if w is None else w - 1} preceding and current row)"
    sel = ", ".join(f"avg(ov) over {frame(w)} as bm{i}, count(ov) over {frame(w)} as bn{i}" for i, w in enumerate((*windows, None), 1))
    step(f"{name}_bank2", f"select *, {sel} from {name}_bank1")
    parts = [f"case when {ON} then {ev(f'bn{i}', f'bm{i}', 'rm', 'rs')} end" for i in range(1, len(windows) + 2)]
    cols = ", ".join(f"{p} as {out}{i}" for i, p in enumerate(parts, 1))
    names = " + ".join(f"{out}{i}" for i in range(1, len(windows) + 2))
    drop = ", ".join(["bv", "rm", "rs", "ov"] + [f"bm{i}, bn{i}" for i in range(1, len(windows) + 2)])
    step(f"{name}_bank3", f"select * exclude ({drop}), {cols} from {name}_bank2")
    return step(name, f"select *, ({names}) / {len(windows) + 1} as {out} from {name}_bank3")


# Raw energy: against C, and against the whole history.
step("raw_1", f"select *, {over('avg', REF, 'value')} as rmu, {sd(REF, 'value')} as rsd from series")
step("raw_2", "select * exclude (rmu, rsd), pow((value - rmu) / rsd, 2) as zz from raw_1")
bank("raw", "raw_2", "zz", "blk_r")
step("rawh_1", f"select *, {over('avg', 'period = 1', 'value')} as rmu, {sd('period = 1', 'value')} as rsd from series")
step("rawh_2", "select * exclude (rmu, rsd), pow((value - rmu) / rsd, 2) as zz from rawh_1")
bank("rawh", "rawh_2", "zz", "blk_r", ref="period = 1")


def autoregression(name: str, source: str, p: int, fit: str) -> str:
    """Step name: source with ar_mu, ar_sd, az, e, b0.. ; step <name>_coef: the coefficients by id."""
    step(f"{name}_z1", f"select *, {over('avg', fit, 'value')} as ar_mu, {over('stddev_samp', fit, 'value')} as ar_sd from {source}")
    step(f"{name}_z2", f"select *, (value - ar_mu) / ar_sd as az from {name}_z1")
    lags = ", ".join(f"lag(az, {j}) over (partition by id order by k) as l{j}" for j in range(1, p + 1))
    step(f"{name}_z3", f"select *, {lags} from {name}_z2")
    x = ["1.0"] + [f"l{j}" for j in range(1, p + 1)]
    sums = [f"sum({x[i]} * {x[j]}) + {1.0 if i == j and i else 0.0} as m{i}_{j}" for i in range(p + 1) for j in range(p + 1)]
    sums += [f"sum({x[i]} * az) as m{i}_{p + 1}" for i in range(p + 1)]
    step(f"{name}_g", f"select id, {', '.join(sums)} from {name}_z3 where {fit} and l{p} is not null group by id")
    before = f"{name}_g"
    for q in range(p + 1):
        cols = []
        for i in range(p + 1):
            for j in range(p + 2):
                cell = f"m{q}_{j} / m{q}_{q}" if i == q else f"m{i}_{j} - m{i}_{q} * (m{q}_{j} / m{q}_{q})"
                cols.append(f"{cell} as m{i}_{j}")
        before = step(f"{name}_e{q}", f"select id, {', '.join(cols)} from {before}")
    step(f"{name}_coef", f"select id, {', '.join(f'm{i}_{p + 1} as b{i}' for i in range(p + 1))} from {before}")
    terms = "".join(f" - b{j} * l{j}" for j in range(1, p + 1))
    drop = ", ".join(f"l{j}" for j in range(1, p + 1))
    return step(name, f"select * exclude ({drop}), az - b0{terms} as e from {name}_z3 join {name}_coef using (id)")


autoregression("ar", "series", 5, FIT)
step("inn_1", f"select *, {over('avg', REF, 'e')} as e_mu, {sd(REF, 'e')} as e_sd, {over('avg', REF, 'e * e')} / nullif({over('avg', REF, 'az * az')}, 0) as mse_ratio from ar")
step("inn_2", "select *, (e - e_mu) / e_sd as r from inn_1")
step("inn_3", "select *, r * r as rr from inn_2")
bank("inn", "inn_3", "rr", "blk_i")


def midrank(name: str, source: str, value: str, out: str) -> str:
    one = f"(case when {REF} then 1 else 0 end)"
    step(f"{name}_1", f"select *, sum{one} over (partition by id order by {value} range between unbounded preceding and current row) as mle, sum{one} over (partition by id, {value}) as meq, sum{one} over ({P}) as mm from {source}")
    return step(name, f"select * exclude (mle, meq, mm), (mle - meq / 2.0::double + 0.5::double) / (mm + 1) as {out} from {name}_1")


def rank_block(name: str, source: str, value: str, out: str) -> str:
    midrank(f"{name}_u", source, value, f"{out}_u")
    step(f"{name}_v", f"select *, 2 * {out}_u - 1 as {out}_v, (2 * {out}_u - 1) * (2 * {out}_u - 1) as {out}_w from {name}_u")
    bank(f"{name}_loc", f"{name}_v", f"{out}_v", f"{out}_location")
    bank(f"{name}_en", f"{name}_loc", f"{out}_w", f"{out}_energy")
    return step(name, f"select *, ({out}_location + {out}_energy) / 2 as {out} from {name}_en")


rank_block("rnk", "inn", "r", "blk_p")


def corr_sums(m, sa, sb, saa, sbb, sab) -> str:
    va, vb = f"({saa} - {sa} * {sa} / nullif({m}, 0))", f"({sbb} - {sb} * {sb} / nullif({m}, 0))"
    return f"case when {m} > 0 and {va} > 1e-12 and {vb} > 1e-12 then greatest(-1.0, least(1.0, ({sab} - {sa} * {sb} / nullif({m}, 0)) / sqrt({va} * {vb}))) end"


step("sgn_0", f"select id as mid, median(e) as med from inn where {REF} group by id")
step("sgn_1", "select *, sign(e - med)::double as sg from inn join sgn_0 on id = mid")
step("sgn_2", f"select *, case when {ON} and t > 0 then lag(sg) over (partition by id order by k) end as pa, case when {REF} and k > cut then lag(sg) over (partition by id order by k) end as ca from sgn_1")


def pair_sums(a: str, window: str, tag: str) -> str:
    y = f"(case when {a} is not null then sg end)"
    items = (f"(case when {a} is not null then 1.0 end)", a, y, f"{a} * {a}", f"{y} * {y}", f"{a} * {y}")
    return ", ".join(f"coalesce(sum({x}) over {window}, 0.0) as {tag}{i}" for i, x in enumerate(items))


_w = lambda n: f"(partition by id order by k rows between {n - 2} preceding and current row)"
step("sgn_3", f"select *, {pair_sums('ca', '(partition by id)', 'sc')}, {pair_sums('pa', _w(128), 'sx')}, {pair_sums('pa', _w(256), 'sy')} from sgn_2")
step("sgn_4", f"select *, {corr_sums(*[f'sc{i}' for i in range(6)])} as cr, {corr_sums(*[f'sx{i}' for i in range(6)])} as rx, {corr_sums(*[f'sy{i}' for i in range(6)])} as ry from sgn_3")
_dep = lambda m, r: f"case when {m} >= 8 and {r} is not null and cr is not null then {ratio(f'sqrt({m}) * abs({r} - cr)')} else 0.0 end"
step("sgn", f"select id, k, t, {_dep('sx0', 'rx')} as blk_d128, {_dep('sy0', 'ry')} as blk_d256 from sgn_4 where {ON}")

step("base", "select r.id, r.k, r.t, r.target, r.tau_index, w.blk_r, r.blk_i, r.blk_i1, r.blk_i2, r.blk_i3, r.blk_i4, r.blk_p, r.blk_p_location, r.blk_p_energy, (s.blk_d128 + s.blk_d256) / 2 as blk_d, r.mse_ratio from rnk r join raw w using (id, k) join sgn s using (id, k) where r.period = 2")


def scale(kind: str, share: float, robust: bool) -> str:
    n = f"sc{kind}"
    fit = f"({FIT} and k >= 5)"
    keep = f"{1 - share!r}::double"
    step(f"{n}_1", "select *, case when k >= 5 then e * e end as e2 from inn")
    step(f"{n}_2", f"select id as sid, greatest(avg(e2), 1e-16) as sb, quantile_cont(e2, 0.99) as cap from {n}_1 where {fit} group by id")
    step(f"{n}_3", f"select id as fid, avg(least(e2, cap)) as clip from {n}_1 join {n}_2 on id = sid where {fit} group by id")
    driver = "case when e2 is null then null when clip > 1e-16 then sb / clip * least(e2, cap) else e2 end" if robust else "e2"
    step(f"{n}_4", f"select *, {driver} as dr from {n}_1 join {n}_2 on id = sid join {n}_3 on id = fid")
    step(f"{n}_5", f"select *, pow({keep}, k - 5) * sb + {share!r}::double * coalesce(pow({keep}, k - 1) * sum(dr * pow({keep}, -k)) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0.0) as hh from {n}_4")
    step(f"{n}_6", f"select * exclude (sid, fid), case when k >= 5 then greatest(hh, 1e-16, 1e-4 * sb) end as v_{kind} from {n}_5")
    step(f"{n}_7", f"select *, e / sqrt(v_{kind}) as u_{kind} from {n}_6")
    step(f"{n}_8", f"select *, (u_{kind} - {over('avg', REF, f'u_{kind}')}) / {sd(REF, f'u_{kind}')} as a_{kind} from {n}_7")
    step(f"{n}_9", f"select *, pow(a_{kind}, 2) as a2 from {n}_8")
    return bank(n, f"{n}_9", "a2", f"blk_j{kind}")


scale("s", 0.01, False)
scale("f", 0.05, False)
scale("r", 0.01, True)
rank_block("rks", "scs", "a_s", "blk_ps")
step("jall", "select b.*, s.blk_js, f.blk_jf, r.blk_jr, p.blk_ps, s.v_s, f.v_f, r.v_r, s.e2 from base b join scs s using (id, k) join scf f using (id, k) join scr r using (id, k) join rks p using (id, k)")


def _poly(c, x: str) -> str:
    out = f"{c[-1]!r}::double"
    for k in reversed(c[:-1]):
        out = f"({out} * {x} + {k!r}::double)"
    return out


def quantile(p: str) -> str:
    rat = lambda c, x: f"({_poly(c[0], x)} / {_poly(c[1], x)})"
    r = f"sqrt(-ln(case when {p} < 0.5 then {p} else 1 - {p} end))"
    c = f"(0.180625::double - ({p} - 0.5::double) * ({p} - 0.5::double))"
    return f"case when abs({p} - 0.5::double) <= 0.425 then ({p} - 0.5::double) * {rat(CENTRE, c)} else sign({p} - 0.5::double) * (case when {r} <= 5 then {rat(MIDDLE, f'({r} - 1.6::double)')} else {rat(TAIL, f'({r} - 5)')} end) end"


midrank("nz_1", "scs", "u_s", "np")
step("nz_2", f"select id, k, t, h, cut, period, target, u_s, np, case when u_s is not null then {quantile('np')} end as nz from nz_1")
step("nz_3", f"select *, {over('avg', REF, 'nz')} as nz_mu from nz_2")
step("nz", f"select *, {over('avg', REF, 'pow(nz - nz_mu, 2)')} as nz_v0 from nz_3")

_channels = {
    "m1": "nz", "m2": "(nz * nz - 1) / sqrt(2.0::double)", "m3": "(nz * nz * nz - 3 * nz) / sqrt(6.0::double)",
    "m4": "(nz * nz * nz * nz - 6 * nz * nz + 3) / sqrt(24.0::double)", "m5": "(nz - nz_mu) * lag(nz - nz_mu) over (partition by id order by k)",
}
step("mom_1", "select *, " + ", ".join(f"{v} as r{k}" for k, v in _channels.items()) + " from nz")
step("mom_2", "select *, " + ", ".join((lambda ref, live: f"case when {live} then (r{k} - {over('avg', ref, f'r{k}')}) / {sd(ref, f'r{k}')} end as s{k}")(*((f"({REF} and k > cut)", f"({ON} and t > 0)") if k == "m5" else (REF, ON))) for k in _channels) + " from mom_1")
for _k in _channels:
    _wins = [w - (1 if _k == "m5" else 0) for w in (32, 128, 512)]
    _frames = [f"(partition by id order by k rows between {w - 1} preceding and current row)" for w in _wins] + ["(partition by id order by k rows between unbounded preceding and current row)"]
    step(f"mom_{_k}a", f"select id, k, period, t, " + ", ".join(f"count(s{_k}) over {f} as n{i}, avg(s{_k}) over {f} as a{i}" for i, f in enumerate(_frames)) + " from mom_2")
    _few = 8 if _k == "m5" else 1
    _q = [f"case when n{i} >= {_few} then {ratio(f'sqrt(n{i}) * abs(a{i})')} else 0.0 end" for i in range(4)]
    step(f"mom_{_k}", f"select id, k, (greatest({', '.join(_q[:3])}) + {_q[3]}) / 2 as {_k} from mom_{_k}a where {ON}")

_lag = [f"lag(q, {g}) over (partition by id order by k)" for g in range(1, 17)]
step("hac_1", f"select id, k, nz_v0, pow(nz - nz_mu, 2) - nz_v0 as q from nz where {REF}")
step("hac_2", "select *, " + ", ".join(f"q * {x} as q{g}" for g, x in enumerate(_lag, 1)) + " from hac_1")
step("hac_3", "select id, count(q) as m, max(nz_v0) as v0, greatest((sum(q * q) + " + " + ".join(f"2 * (1 - {g} / 17.0::double) * coalesce(sum(q{g}), 0.0)" for g in range(1, 17)) + ") / count(q), 0.0) as lrv from hac_2 group by id")
step("hac", "select id, case when m >= 34 and v0 > 1e-16 then greatest(1.0, lrv / (2 * v0 * v0)) else 1.0 end as hac_eta from hac_3")

_frames = [f"(partition by id order by k rows between {w - 1} preceding and current row)" for w in (32, 128, 512)] + ["(partition by id order by k rows between unbounded preceding and current row)"]
step("lik_1", f"select id, k, t, period, nz_v0 as v0, case when {ON} then pow(nz - nz_mu, 2) end as q from nz")
step("lik_2", "select *, " + ", ".join(f"count(q) over {f} as n{i}, avg(q) over {f} as a{i}" for i, f in enumerate(_frames)) + " from lik_1")
step("lik_3", f"select * from lik_2 join hac using (id) where {ON}")


def _direction(i: int, up: bool, eta: str) -> str:
    r = f"(greatest(a{i}, 0.0) / v0)"
    d = f"({r} - 1)"
    kernel = f"greatest(case when abs({d}) <= 0.5 then {d} - ln(1 + {d}) when {r} > 0 then {d} - ln({r}) end, 0.0)"
    value = ratio(f"n{i} / 2.0::double * {kernel} / {eta}")
    ok = f"v0 > 1e-16 and n{i} >= 8"
    if up:
        return f"case when {ok} and {r} > 1 then {value} else 0.0 end"
    return f"case when {ok} and {r} = 0 then 1.0 when {ok} and {r} < 1 then {value} else 0.0 end"


_sides = []
for _name, _eta in (("l", "1.0"), ("c", "hac_eta")):
    for _side in ("plus", "minus"):
        _parts = [_direction(i, _side == "plus", _eta) for i in range(4)]
        _sides.append(f"(greatest({', '.join(_parts[:3])}) + {_parts[3]}) / 2 as {_name}_{_side}")
step("lik", f"select id, k, t, hac_eta, {', '.join(_sides)} from lik_3")
step("traj", f"select *, greatest(0.0, max(cur) over {CUM}) - cur as drawdown, 0.01::double * pow(0.99::double, t) * sum(cur * pow(0.99::double, -t)) over {CUM} as trajectory_ewma from (select *, greatest(l_plus, l_minus) as cur from lik)")

# The same blocks of C itself, as if it were the stream.
step("null_nz", f"select id, k, t, h, cut, period, nz, nz_mu, nz_v0 from nz where period = 1 union all select id, h + k - cut as k, k - cut as t, h, cut, 2 as period, nz, nz_mu, nz_v0 from nz where {REF}")
for _n in [n for n in STEPS if re.match(r"(mom|hac|lik)", n)]:
    step(f"null_{_n}", re.sub(r"\b(from|join) (nz|mom_\w+|hac\w*|lik\w*)\b", r"\1 null_\2", STEPS[_n]))

# Scores that the scoring queries rank: two detectors, to six decimals, with folds.
STRATUM = "case when tau_index = -1 then 'no_break' when tau_index + 1 <= 64 then 'break_1_64' when tau_index + 1 <= 128 then 'break_65_128' when tau_index + 1 <= 256 then 'break_129_256' when tau_index + 1 <= 512 then 'break_257_512' else 'break_513_plus' end"
step("man_1", "select id, max(tau_index) as tau_index, count(case when period = 1 then 1 end) as history_length, count(case when period = 2 then 1 end) as online_length from series group by id")
step("man_2", f"select *, (tau_index >= 0)::int as has_break, {STRATUM} as stratum from man_1")
step("manifest", "select *, ((row_number() over (partition by stratum order by sha256(id::varchar), id) - 1) % 5)::int as fold from man_2")
step("scores", "select a.id, a.t, a.target, a.tau_index, round(a.score, 6) + 0.0 as candidate, round(b.score, 6) + 0.0 as reference, m.fold, m.stratum from d_squared a join d_cusum b using (id, t) join manifest m using (id)")


def auc_terms(source: str, score: str, by: str = "") -> str:
    """A select of by, t, active, positive, negative, u, weight."""
    g = f"{by}, t" if by else "t"
    ranked = f"select {g}, target, rank() over (partition by {g} order by {score}) + (count(*) over (partition by {g}, {score}) - 1) / 2.0::double as mr from {source}"
    return f"""select {g}, count(*) as active, sum(target)::bigint as positive, (count(*) - sum(target))::bigint as negative,
        coalesce(sum(case when target = 1 then mr end), 0) - sum(target) * (sum(target) + 1) / 2.0::double as u, (sum(target) * (count(*) - sum(target)))::bigint as weight
        from ({ranked}) group by {g}"""


step("terms", auc_terms("scores", "candidate"))
step("rterms", auc_terms("scores", "reference"))
