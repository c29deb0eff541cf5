"""The iterations of the trained models as SQL steps, one step per half iteration or epoch.

The models' starts and draws are md5 numbers, so DuckDB can repeat them; a
grouped sum is the same in both up to the order of its terms.
"""

from __future__ import annotations

from tasteforge.functions.hashing import uniform_sql
from tasteforge.models import bpr_local
from tasteforge.models.ridge import UNIT_SPREAD
from tasteforge.plans.registry import step

SEED = 16
ADAGRAD_FLOOR = "1e-12"

NUMBERS = {"user": ("cnt_compliment", "yelp_days", "elite_years"), "item": ("review_count", "stars")}
INFO = {"user": "user_info", "item": "features"}
KEY = {"user": "user_id", "item": "business_id"}

step(
    "user_info",
    "users",
    """select user_id, segment,
              coalesce(compliment_hot, 0) + coalesce(compliment_cool, 0) + coalesce(compliment_note, 0) as cnt_compliment,
              date_diff('day', member_since, date '2019-12-31') as yelp_days,
              case when elite is null or elite = '' then 0 else len(string_split(elite, ',')) end as elite_years
       from users""",
)
step("cells", "train", "select user_id, business_id, sum(stars) as total, count(*) as n from train group by 1, 2")


def scaled_sql(column: str, table: str, name: str | None = None, key: str = "key") -> str:
    """(key, feature, value) of a numeric column with mean 0 and deviation 1."""
    return f"""select {key} as key, '{name or column}' as feature,
                      ({column} - avg({column}) over ()) / coalesce(nullif(stddev_samp({column}) over (), 0), 1) as value
               from {table} where {column} is not null"""


def ridge_steps(tag: str, entries: str, reg: float, iterations: int) -> None:
    """Two factors per id: {tag}_l{n} and {tag}_r{n} from entries (l, r, x, w)."""
    first, second = (f"({uniform_sql(SEED, 'id', j)} - 0.5) * {UNIT_SPREAD!r}" for j in ("1", "2"))
    step(f"{tag}_r0", entries, f"select id, {first} as f1, {second} as f2 from (select distinct r as id from {entries})")
    for n in range(1, iterations + 1):
        for own, other, fixed in (("l", "r", f"{tag}_r{n - 1}"), ("r", "l", f"{tag}_l{n}")):
            step(
                f"{tag}_{own}{n}",
                f"{entries} {fixed}",
                f"""select id, (p * d - b * q) / (a * d - b * b) as f1, (a * q - b * p) / (a * d - b * b) as f2 from (
                        select e.{own} as id, sum(w * f1 * f1) + {reg} as a, sum(w * f1 * f2) as b, sum(w * f2 * f2) + {reg} as d,
                               sum(w * x * f1) as p, sum(w * x * f2) as q
                        from {entries} e join {fixed} f on e.{other} = f.id group by 1)""",
            )


def mf_steps(reg: float, epochs: int) -> None:
    """Step ``mf_rated``; reads the bias steps of the same number of epochs."""
    bias = f"mean bi{epochs} bu{epochs}"
    step(
        "mf_entries",
        f"cells {bias}",
        f"""select c.user_id as l, c.business_id as r, total / n - (mean + coalesce(b_u, 0) + coalesce(b_i, 0)) as x, n as w
            from cells c left join bi{epochs} i on c.business_id = i.business_id left join bu{epochs} u on c.user_id = u.user_id, mean""",
    )
    ridge_steps("mf", "mf_entries", reg, epochs)
    step(
        "mf_rated",
        f"test mf_l{epochs} mf_r{epochs} {bias}",
        f"""select t.user_id, t.business_id, t.stars, least(greatest(mean + coalesce(b_u, 0) + coalesce(b_i, 0)
                   + coalesce(l.f1 * r.f1 + l.f2 * r.f2, 0), 1.0), 5.0) as prediction
            from test t left join bi{epochs} i on t.business_id = i.business_id left join bu{epochs} u on t.user_id = u.user_id
            left join mf_l{epochs} l on t.user_id = l.id left join mf_r{epochs} r on t.business_id = r.id, mean""",
    )


def cmf_steps(reg: float, iterations: int, w_user: float, w_item: float) -> None:
    """Step ``cmf_rated``: ratings and both side tables as one table of entries."""
    numeric = {
        side: " union all ".join(scaled_sql(column, INFO[side], key=KEY[side]) for column in NUMBERS[side]) for side in NUMBERS
    }
    flags = " union all ".join(
        f"""select business_id, '{column}=' || v, case when {column} = v then 1.0 else 0.0 end
            from features, (select distinct {column} as v from features where {column} is not null)"""
        for column in ("top_category", "state")
    )
    step("cmf_mean", "cells", "select sum(total) / sum(n) as m from cells")
    step(
        "cmf_entries",
        "cells cmf_mean user_info features",
        f"""select 'u:' || user_id as l, 'i:' || business_id as r, total / n - m as x, cast(n as double) as w from cells, cmf_mean
            union all select 'u:' || key, 'f:' || feature, value, {w_user} from ({numeric['user']})
            union all select 'f:' || feature, 'i:' || key, value, {w_item} from ({numeric['item']} union all {flags})""",
    )
    ridge_steps("cmf", "cmf_entries", reg, iterations)
    step(
        "cmf_rated",
        f"test cmf_mean cmf_l{iterations} cmf_r{iterations}",
        f"""select t.user_id, t.business_id, t.stars, m + coalesce(l.f1 * r.f1 + l.f2 * r.f2, 0) as prediction
            from test t left join cmf_l{iterations} l on l.id = 'u:' || t.user_id
            left join cmf_r{iterations} r on r.id = 'i:' || t.business_id, cmf_mean""",
    )


def start_step(name: str, keys: str, needs: str, k: int, spread: float) -> None:
    """Parameters (kind, key, w, v0 .., aw, av) before the first gradient."""
    factors = ", ".join(f"({uniform_sql(f'{SEED}-{j}', 'kind', 'key')} - 0.5) * {2 * spread} as v{j}" for j in range(k))
    step(name, needs, f"select kind, key, 0.0::double as w, {factors}, 0.0::double as aw, 0.0::double as av from ({keys})")


def gradient_step(name: str, before: str, grads: str, k: int, rate: float, reg_w: float, reg_v: float, per_row: bool) -> None:
    """Parameters after one Adagrad step down ``grads`` (kind, key, n, gw, g0 ..); ids without a gradient stay."""
    share = "1" if per_row else "(1 / g.n)"
    gw = f"(g.gw / g.n + {reg_w} * {share} * p.w)"
    gv = [f"(g.g{j} / g.n + {reg_v} * {share} * p.v{j})" for j in range(k)]
    aw, av = f"(p.aw + {gw} * {gw})", f"(p.av + {' + '.join(f'{g} * {g}' for g in gv)})"
    new = {"w": f"p.w - {rate} * {gw} / sqrt({aw} + {ADAGRAD_FLOOR})"}
    new |= {f"v{j}": f"p.v{j} - {rate} * {gv[j]} / sqrt({av} + {ADAGRAD_FLOOR})" for j in range(k)}
    new |= {"aw": aw, "av": av}
    columns = ", ".join(f"case when g.n is null then p.{column} else {value} end as {column}" for column, value in new.items())
    step(name, f"{before} {grads}", f"select p.kind, p.key, {columns} from {before} p left join {grads} g on p.kind = g.kind and p.key = g.key")


def fm_steps(iterations: int, k: int, rate: float, reg_w: float, reg_v: float) -> None:
    """Step ``fm_rated``: a factorisation machine with the side columns of users and items."""
    texts = {"user": ("segment",), "item": ("top_category", "state", "city")}
    names = {"stars": "average_stars"}
    for side in INFO:
        columns = (*texts[side], *NUMBERS[side])
        whole = f"fm_{side}_whole"
        step(whole, INFO[side], f"select {KEY[side]} as key, {', '.join(columns)} from {INFO[side]} where "
             + " and ".join(f"{c} is not null" for c in (KEY[side], *columns)))
        parts = [f"select key, '{c}=' || {c} as feature, 1.0::double as value from {whole}" for c in texts[side]]
        parts += [scaled_sql(c, whole, names.get(c)) for c in NUMBERS[side]]
        step(f"fm_{side}", whole, " union all ".join(parts))
    step(
        "fm_cells",
        "cells fm_user fm_item",
        """select * from cells where user_id in (select key from fm_user) and business_id in (select key from fm_item)""",
    )
    step("fm_mean", "fm_cells", "select sum(total) / sum(n) as m from fm_cells")
    start_step(
        "fm_p0",
        """select distinct 'u' as kind, user_id as key from fm_cells union all select distinct 'i', business_id from fm_cells
           union all select distinct 'us', feature from fm_user union all select distinct 'is', feature from fm_item""",
        "fm_cells fm_user fm_item",
        k,
        0.1,
    )
    kinds = (("user", "u", "us"), ("item", "i", "is"))
    js = range(k)

    def blocks(n: int) -> None:
        for side, own, shared in kinds:
            sums = ", ".join(f"sum(value * v{j}) as s{j}" for j in js)
            squares = " + ".join(f"v{j} * v{j}" for j in js)
            step(
                f"fm_{side}_block{n}",
                f"fm_p{n} fm_{side}",
                f"""select p.key, p.w + s.lin as lin, {', '.join(f'p.v{j} + s.s{j} as s{j}' for j in js)},
                           {' + '.join(f'p.v{j} * p.v{j}' for j in js)} + s.q as q
                    from fm_p{n} p join (
                        select f.key, sum(value * w) as lin, {sums}, sum(value * value * ({squares})) as q
                        from fm_{side} f join fm_p{n} p on p.kind = '{shared}' and p.key = f.feature group by 1
                    ) s on p.kind = '{own}' and p.key = s.key""",
            )

    both = [f"(u.s{j} + i.s{j})" for j in js]
    prediction = f"m + u.lin + i.lin + 0.5 * ({' + '.join(f'{b} * {b}' for b in both)} - u.q - i.q)"
    for n in range(iterations):
        blocks(n)
        joined = f"join fm_user_block{n} u on c.user_id = u.key join fm_item_block{n} i on c.business_id = i.key, fm_mean"
        step(
            f"fm_scored{n}",
            f"fm_cells fm_mean fm_user_block{n} fm_item_block{n}",
            f"""select user_id, business_id, n, e, {', '.join(f'e * b{j} as g{j}' for j in js)} from (
                    select c.user_id, c.business_id, c.n, c.n * ({prediction}) - c.total as e,
                           {', '.join(f'{b} as b{j}' for j, b in enumerate(both))} from fm_cells c {joined})""",
        )
        own = " union all ".join(
            f"select '{kind}' as kind, {KEY[side]} as key, sum(n) as n, sum(e) as gw, "
            f"{', '.join(f'sum(g{j}) as g{j}' for j in js)}, sum(e) as x2e from fm_scored{n} group by 1, 2"
            for side, kind, _ in kinds
        )
        step(f"fm_own{n}", f"fm_scored{n}", own)
        shared = " union all ".join(
            f"select '{feature_kind}', feature, sum(n), sum(value * gw), {', '.join(f'sum(value * g{j})' for j in js)}, "
            f"sum(value * value * gw) from fm_{side} f join fm_own{n} o on o.kind = '{kind}' and o.key = f.key group by 1, 2"
            for side, kind, feature_kind in kinds
        )
        step(
            f"fm_grad{n}",
            f"fm_own{n} fm_user fm_item fm_p{n}",
            f"""select g.kind, g.key, n, gw, {', '.join(f'g{j} - v{j} * x2e as g{j}' for j in js)}
                from (select * from fm_own{n} union all {shared}) g join fm_p{n} p on p.kind = g.kind and p.key = g.key""",
        )
        gradient_step(f"fm_p{n + 1}", f"fm_p{n}", f"fm_grad{n}", k, rate, reg_w, reg_v, per_row=False)
    blocks(iterations)
    step(
        "fm_rated",
        f"test fm_mean fm_user_block{iterations} fm_item_block{iterations}",
        f"""select c.user_id, c.business_id, c.stars, coalesce({prediction}, 'nan'::double) as prediction
            from test c left join fm_user_block{iterations} u on c.user_id = u.key
            left join fm_item_block{iterations} i on c.business_id = i.key, fm_mean""",
    )


def fm_als_steps(rounds: int, reg_w: float, reg_v: float) -> None:
    """Step ``als_rated``: one factor by coordinate descent, ids and then side columns of users, then of items.

    Reads the features and cells of ``fm_steps``.  In a side's sums n, m, mm are
    those of n, n s, n s s and y, ys those of t, t s over its ratings, with the
    other side's s; e and es are the residuals' sums, renewed after each step.
    """
    kinds = {"user": ("u", "us"), "item": ("i", "is")}
    start_step(
        "als_p0",
        """select distinct 'u' as kind, user_id as key from fm_cells union all select distinct 'i', business_id from fm_cells
           union all select distinct 'us', feature from fm_user union all select distinct 'is', feature from fm_item""",
        "fm_cells fm_user fm_item",
        1,
        0.1,
    )
    own = {side: f"als_{side}_own0" for side in kinds}
    levels = {side: f"als_{side}_levels0" for side in kinds}
    for side, (kind, shared) in kinds.items():
        step(own[side], "als_p0", f"select key, w, v0 as v from als_p0 where kind = '{kind}'")
        step(levels[side], "als_p0", f"select key, w, v0 as v from als_p0 where kind = '{shared}'")

    def terms(side: str, name: str) -> None:
        """(key, w, v, a, s) of a side at this point."""
        step(
            name,
            f"{own[side]} {levels[side]} fm_{side}",
            f"""select o.key, o.w, o.v, o.w + lin + 0.5 * ((o.v + fs) * (o.v + fs) - o.v * o.v - q) as a, o.v + fs as s
                from {own[side]} o join (
                    select f.key, sum(value * w) as lin, sum(value * v) as fs, sum(value * value * v * v) as q
                    from fm_{side} f join {levels[side]} l on f.feature = l.key group by 1) p on o.key = p.key""",
        )

    for n in range(1, rounds + 1):
        for side, other in (("user", "item"), ("item", "user")):
            tag = f"als_{side}{n}"
            terms(side, f"{tag}_own_terms")
            terms(other, f"{tag}_other_terms")
            step(
                f"{tag}_sums",
                f"fm_cells fm_mean {tag}_other_terms",
                f"""select c.{KEY[side]} as key, sum(n) as n, sum(n * s) as m, sum(n * s * s) as mm,
                           sum(total - n * (fm_mean.m + a)) as y, sum((total - n * (fm_mean.m + a)) * s) as ys
                    from fm_cells c join {tag}_other_terms o on c.{KEY[other]} = o.key, fm_mean group by 1""",
            )
            step(
                f"{tag}_w",
                f"{tag}_sums {tag}_own_terms",
                f"""select key, n, m, mm, w + d as w, v, s, e - n * d as e, es - m * d as es from (
                        select *, (e - {reg_w} * w) / (n + {reg_w}) as d from (
                            select t.*, n, m, mm, y - n * a - m * s as e, ys - m * a - mm * s as es
                            from {tag}_own_terms t join {tag}_sums q on t.key = q.key))""",
            )
            step(
                f"{tag}_v",
                f"{tag}_w",
                f"""select key, n, m, mm, w, v + d as v, s + d as s, e - d * (c * n + m) as e, es - d * (c * m + mm) as es from (
                        select *, (c * e + es - {reg_v} * v) / (c * c * n + 2 * c * m + mm + {reg_v}) as d
                        from (select *, s - v as c from {tag}_w))""",
            )
            step(f"{tag}_own", f"{tag}_v", f"select key, w, v from {tag}_v")
            step(
                f"{tag}_levels",
                f"{levels[side]} {tag}_v fm_{side}",
                f"""select key, w + coalesce(d, 0) / columns as w, v + coalesce((gv - d * wv - {reg_v} * v) / (vv + {reg_v}), 0) / columns as v from (
                        select *, (gw - {reg_w} * w) / (ww + {reg_w}) as d from (
                            select l.key, l.w, l.v, sum(x * e) as gw, sum(x * ((s - x * l.v) * e + es)) as gv, sum(x * x * n) as ww,
                                   sum(x * x * ((s - x * l.v) * n + m)) as wv,
                                   sum(x * x * ((s - x * l.v) * (s - x * l.v) * n + 2 * (s - x * l.v) * m + mm)) as vv
                            from {levels[side]} l left join (
                                select f.feature, f.value as x, r.n, r.m, r.mm, r.s, r.e, r.es from fm_{side} f join {tag}_v r on f.key = r.key
                            ) z on l.key = z.feature group by 1, 2, 3)),
                        (select count(distinct split_part(feature, '=', 1)) as columns from fm_{side})""",
            )
            own[side], levels[side] = f"{tag}_own", f"{tag}_levels"
    for side in kinds:
        terms(side, f"als_{side}_terms")
    step(
        "als_rated",
        "test fm_mean als_user_terms als_item_terms",
        """select c.user_id, c.business_id, c.stars, coalesce(m + u.a + i.a + u.s * i.s, 'nan'::double) as prediction
           from test c left join als_user_terms u on c.user_id = u.key left join als_item_terms i on c.business_id = i.key, fm_mean""",
    )


def bpr_steps(iterations: int, k: int, rate: float, reg: float) -> None:
    """Step ``bpr_scored``: candidates scored after epochs of one drawn item per positive."""
    step("bpr_codes", "train", "select business_id, row_number() over (order by business_id) - 1 as i from (select distinct business_id from train)")
    step("bpr_size", "bpr_codes", "select count(*) as items from bpr_codes")
    step("bpr_positives", "train bpr_codes", "select distinct user_id, i from train join bpr_codes using (business_id)")
    start_step(
        "bpr_p0",
        "select distinct 'u' as kind, user_id as key from bpr_positives union all select 'i', cast(i as varchar) from bpr_codes",
        "bpr_positives bpr_codes",
        k,
        0.1,
    )
    js = range(k)
    for n in range(iterations):
        drawn = uniform_sql(f"{SEED}-{n}", "user_id", "i")
        step(
            f"bpr_triples{n}",
            "bpr_positives bpr_size",
            f"""select d.* from (select user_id, i, cast(floor({drawn} * items) as bigint) as j from bpr_positives, bpr_size) d
                left join bpr_positives p on d.user_id = p.user_id and d.j = p.i where p.i is null""",
        )
        step(
            f"bpr_z{n}",
            f"bpr_triples{n} bpr_p{n}",
            f"""select t.*, 1 / (1 + exp(p.w - m.w + {' + '.join(f'u.v{x} * (p.v{x} - m.v{x})' for x in js)})) as z,
                       {', '.join(f'u.v{x} as u{x}, m.v{x} - p.v{x} as d{x}' for x in js)}
                from bpr_triples{n} t join bpr_p{n} u on u.kind = 'u' and u.key = t.user_id
                join bpr_p{n} p on p.kind = 'i' and p.key = cast(t.i as varchar)
                join bpr_p{n} m on m.kind = 'i' and m.key = cast(t.j as varchar)""",
        )
        moved = " union all ".join(
            [
                f"select 'u' as kind, user_id as key, 0.0::double as gw, {', '.join(f'z * d{x} as g{x}' for x in js)} from bpr_z{n}",
                f"select 'i', cast(i as varchar), -z, {', '.join(f'-z * u{x}' for x in js)} from bpr_z{n}",
                f"select 'i', cast(j as varchar), z, {', '.join(f'z * u{x}' for x in js)} from bpr_z{n}",
            ]
        )
        sums = ", ".join(f"sum(g{x}) as g{x}" for x in js)
        step(f"bpr_grad{n}", f"bpr_z{n}", f"select kind, key, count(*) as n, sum(gw) as gw, {sums} from ({moved}) group by 1, 2")
        gradient_step(f"bpr_p{n + 1}", f"bpr_p{n}", f"bpr_grad{n}", k, rate, reg, reg, per_row=True)
    step(
        "bpr_scored",
        f"candidates bpr_codes bpr_p{iterations}",
        f"""select c.user_id, c.candidate_id as business_id, p.w + {' + '.join(f'u.v{x} * p.v{x}' for x in js)} as prediction
            from candidates c join bpr_codes b on c.candidate_id = b.business_id
            join bpr_p{iterations} u on u.kind = 'u' and u.key = c.user_id
            join bpr_p{iterations} p on p.kind = 'i' and p.key = cast(b.i as varchar)""",
    )


def bpr_local_steps(epochs: int, k: int, blocks: int, rate: float, reg: float) -> None:
    """Step ``bpr_local_scored``: every block takes its positives at once, then factors become means weighted by updates."""
    js = range(k)
    step("bprl_users", "train", "select user_id, row_number() over (order by user_id) - 1 as u from (select distinct user_id from train)")
    step(
        "bprl_rows",
        "train bpr_codes bprl_users",
        f"""select *, row_number() over (partition by block order by u, i) - 1 as place, count(*) over (partition by block) as rows from (
                select distinct u, i, cast(floor({uniform_sql('block', 'u', '0')} * {blocks}) as int) as block
                from train join bpr_codes using (business_id) join bprl_users using (user_id))""",
    )
    factors = ", ".join(f"({uniform_sql(f'{SEED}-{j}', 'kind', 'key')} - 0.5) * 0.2 as v{j}" for j in js)
    step(
        "bprl_p0",
        "bprl_rows bpr_codes",
        f"select kind, key, 0.0::double as w, {factors} from (select distinct 'u' as kind, u as key from bprl_rows union all select 'i', i from bpr_codes)",
    )
    for n in range(epochs):
        ring = f"(place * {bpr_local.STEP} + cast(floor({uniform_sql(f'{SEED}-{n}', 'block')} * {bpr_local.RING}) as bigint)) % {bpr_local.RING}"
        step(
            f"bprl_triples{n}",
            "bprl_rows",
            f"""select d.block, d.u, d.i, o.i as j from (select *, cast(({ring}) * rows as bigint) >> 32 as drawn from bprl_rows) d
                join bprl_rows o on o.block = d.block and o.place = d.drawn
                left join bprl_rows p on p.u = d.u and p.i = o.i where p.i is null""",
        )
        ahead = " + ".join(f"u.v{x} * (p.v{x} - m.v{x})" for x in js)
        step(
            f"bprl_z{n}",
            f"bprl_triples{n} bprl_p{n}",
            f"""select t.*, 1 / (1 + exp(p.w - m.w + {ahead})) as z, p.w as pw, m.w as mw,
                       {', '.join(f'u.v{x} as u{x}, p.v{x} as p{x}, m.v{x} as m{x}' for x in js)}
                from bprl_triples{n} t join bprl_p{n} u on u.kind = 'u' and u.key = t.u
                join bprl_p{n} p on p.kind = 'i' and p.key = t.i join bprl_p{n} m on m.kind = 'i' and m.key = t.j""",
        )
        moved = " union all ".join(
            [
                f"select block, 'u' as kind, u as key, 0.0::double as gw, {', '.join(f'z * (p{x} - m{x}) - {reg} * u{x} as g{x}' for x in js)} from bprl_z{n}",
                f"select block, 'i', i, z - {reg} * pw, {', '.join(f'z * u{x} - {reg} * p{x}' for x in js)} from bprl_z{n}",
                f"select block, 'i', j, -z - {reg} * mw, {', '.join(f'-z * u{x} - {reg} * m{x}' for x in js)} from bprl_z{n}",
            ]
        )
        names = {"w": "gw", **{f"v{x}": f"g{x}" for x in js}}
        step(
            f"bprl_sums{n}",
            f"bprl_z{n}",
            f"select block, kind, key, count(*) as n, {', '.join(f'sum({g}) as {g}' for g in names.values())} from ({moved}) group by 1, 2, 3",
        )
        step(
            f"bprl_p{n + 1}",
            f"bprl_p{n} bprl_sums{n}",
            f"""select p.kind, p.key, {', '.join(f'coalesce({c}_mean, p.{c}) as {c}' for c in names)} from bprl_p{n} p left join (
                    select s.kind, s.key, {', '.join(f'sum(n * ({c} + {rate} * {g})) / sum(n) as {c}_mean' for c, g in names.items())}
                    from bprl_sums{n} s join bprl_p{n} b on s.kind = b.kind and s.key = b.key group by 1, 2
                ) q on p.kind = q.kind and p.key = q.key""",
        )
    step(
        "bpr_local_scored",
        f"test bpr_codes bprl_users bprl_p{epochs}",
        f"""select t.user_id, t.business_id, p.w + {' + '.join(f'u.v{x} * p.v{x}' for x in js)} as prediction
            from (select distinct user_id, business_id from test) t join bprl_users a on t.user_id = a.user_id
            join bpr_codes b on t.business_id = b.business_id
            join bprl_p{epochs} u on u.kind = 'u' and u.key = a.u join bprl_p{epochs} p on p.kind = 'i' and p.key = b.i""",
    )
