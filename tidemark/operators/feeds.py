"""A page of each user's most relevant opportunities out of all, without a row for each pair.

Users and opportunities are dealt to blocks that meet in cells, as pairs are (relevance.paired()). A cell scores a user's
opportunities as arrays, from the same lists of points, and gives back the user's page; the pages of a user's cells are
merged. What a page leaves out is beaten by `page` opportunities of its own cell, so nothing is lost."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import kept
from . import relevance as R

c = F.col
#: Users and opportunities of a cell at most, and the users of one where there are few.
USERS, OFFERS, FEW = 4_000, 100_000, 500
#: Users whose lists of points are laid out at once; into how many sizes needs are parted for bounds.
CHUNK, NEEDS = 250, 16

LISTS = {
    "geo": "__place_geographic_accessibility",
    "law": "__place_regulatory_accessibility",
    "elsewhere": "__evidence_elsewhere",
    "field": "__field_industry_experience",
    "kind": "__kind_type_preference",
    "risk": "__risk_risk_tolerance_fit",
    "off": "__kind_off",
    "ways": "__way_totals",
}
OF_USER = ("max_capital_usd", "__stretch", "__risk_ceiling", "min_global_score", "min_confidence", "max_capital_required", "show_outside_profile")
KINDS = ("__place", "__evidence", "__field", "__kind", "__risk")
OF_OFFER = ("global_score", "confidence", "capital_required_usd", "__risk_rank", *KINDS, "__ats", "__needs", "__damps")


def _numbers(x: pa.ChunkedArray) -> np.ndarray:
    """As doubles, null as NaN."""
    return x.cast(pa.float64()).to_numpy()


def _lists(x: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length, as a row for each; a null point is NaN."""
    return _numbers(pa.chunked_array([chunk.flatten() for chunk in x.chunks], type=x.type.value_type)).reshape(len(x), -1)


def _numbered(*kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different combinations of kinds, and the number of each row's."""
    found, at = np.unique(np.stack(kinds), axis=1, return_inverse=True)
    return found, at.reshape(-1)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor((x + 1e-9) * 100 + 0.5) / 100


def _capital(needs: np.ndarray, unknown: np.ndarray, ceiling: float | None, stretch: float) -> np.ndarray:
    """relevance._capital()"""
    most = R.FACTORS["capital_fit"]
    if ceiling is None:
        return np.full(needs.shape, most * 0.4)
    if ceiling > 0:
        points = _rounded(most * (0.6 + 0.4 * (1 - needs / ceiling)))
        points = np.where(needs <= ceiling, points if math.isfinite(ceiling) else np.nan_to_num(points, nan=0.0), np.where(needs <= 1.5 * ceiling, stretch, 0.0))
    else:
        points = np.where(needs <= ceiling, most * 0.6, 0.0)
    points[unknown] = most * 0.4
    return points


def _last(points: np.ndarray, page: int) -> float:
    """The `page`th greatest."""
    return np.partition(points, len(points) - page)[len(points) - page]


def _best(at: np.ndarray, points: np.ndarray, page: int, least: float) -> np.ndarray:
    """Of the places `at` those of the `page` greatest points, the greatest first, then the first place."""
    at, points = at[points >= least], points[points >= least]
    if len(at) > page:
        last = _last(points, page)
        at, points = at[points >= last], points[points >= last]
    return at[np.lexsort((at, -points))][:page]


def pages(names: list[str], page: int, include_outside: bool, least: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From the users and the opportunities of a cell, each user's page. An opportunity can't have more points than its
    fixed factors and the most that the same ways give at the least need of those of about its own; only those that can reach
    a page by that are scored."""

    def of_cell(people: pa.Table, offers: pa.Table) -> pa.Table:
        score = offers["global_score"]
        offers = offers.append_column("__odd", pc.fill_null(pc.is_nan(score.cast(pa.float64())), False))
        offers = offers.take(pc.sort_indices(offers, sort_keys=[("__odd", "descending"), ("global_score", "descending"), ("opportunity_id", "ascending")]))
        flat = lambda name: pa.chunked_array([x.flatten() for x in offers[name].chunks], type=offers[name].type.value_type)
        size, stated = pc.list_value_length(offers["__ats"]).to_numpy(), flat("__needs")
        owner, nth = np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])
        most = int(size.max())
        # a row for each first, second and further way; behind `names` is a way that none has
        ats, damps, needs, unknown = np.full((most, len(size)), len(names)), np.ones((most, len(size))), np.zeros((most, len(size))), np.zeros((most, len(size)), bool)
        ats[nth, owner], damps[nth, owner], unknown[nth, owner] = flat("__ats").to_numpy(), flat("__damps").to_numpy(), stated.is_null().to_numpy()
        needs[nth, owner] = np.nan_to_num(stated.to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        place, evidence, field, kind, risk = (offers[k].to_numpy() for k in KINDS)
        sizes = np.unique(_numbers(offers["capital_required_usd"]))
        lists_of_ways, of_list = _numbered(*ats, np.searchsorted(sizes[:: -(-len(sizes) // NEEDS)], _numbers(offers["capital_required_usd"]), "right"))
        lists_of_ways, n_lists = lists_of_ways[:most], lists_of_ways.shape[1]
        # of the opportunities with one list of ways and about one need: the least need, whether any is unknown, the damping
        least_need, any_unknown, damp_of_list = np.full((most, n_lists), np.inf), np.zeros((most, n_lists), bool), np.ones((most, n_lists))
        for i in range(most):
            np.minimum.at(least_need[i], of_list, np.where(unknown[i], np.inf, needs[i]))
            any_unknown[i, of_list[unknown[i]]] = True
            damp_of_list[i, of_list] = damps[i]
        none_unknown = np.zeros_like(any_unknown)
        (of_place, of_evidence), at_place = _numbered(place, evidence)
        (of_field, of_kind, of_risk, of_ways), at_field = _numbered(field, kind, risk, of_list)
        scores, confidence, capital, rank = (_numbers(offers[k]) for k in ("global_score", "confidence", "capital_required_usd", "__risk_rank"))
        rows = {k: people[k].to_pylist() for k in OF_USER}
        step = max(1, len(size) // 2_000)
        whom, what, relevance, path, beyond = [], [], [], [], []

        for begin in range(0, len(people), CHUNK):
            part = people.slice(begin, CHUNK)
            lists = {k: _lists(part[name]) for k, name in LISTS.items()}
            own = np.concatenate((lists["ways"], np.full((len(part), 1), -np.inf)), axis=1)
            geo = lists["geo"][:, of_place]
            far = np.where(lists["elsewhere"][:, of_evidence] == 1, R.FACTORS["geographic_accessibility"] * 0.35, 0.0)
            by_place = np.where(np.isnan(geo), far, geo) + lists["law"][:, of_place]
            by_field = lists["field"][:, of_field] + lists["kind"][:, of_kind] + lists["risk"][:, of_risk]
            for j in range(len(part)):
                i, off = begin + j, lists["off"][j] == 1
                means, budget, ceiling = rows["max_capital_usd"][i], rows["max_capital_required"][i], rows["__risk_ceiling"][i]

                def outside(at: np.ndarray) -> np.ndarray:
                    found = np.ones(len(at), bool) if ceiling is None else rank[at] > ceiling
                    for value, floor in ((scores, rows["min_global_score"][i]), (confidence, rows["min_confidence"][i])):
                        if floor is not None:
                            found |= value[at] < floor
                    if budget is not None:
                        found |= capital[at] > budget
                    if means is not None and means > 0:
                        found |= capital[at] > means
                    return found | off[kind[at]]

                def scored(at: np.ndarray) -> np.ndarray:
                    """Points by each way."""
                    fixed = by_place[j].take(at_place[at]) + by_field[j].take(at_field[at])
                    return _rounded((fixed + own[j].take(ats[:, at]) + _capital(needs[:, at], unknown[:, at], means, rows["__stretch"][i])).clip(max=100.0) * damps[:, at])

                everything = include_outside or rows["show_outside_profile"][i]
                inside = lambda at: at if everything else at[~outside(at)]
                could = _capital(least_need, none_unknown, means, rows["__stretch"][i])
                could[any_unknown] = could[any_unknown].clip(min=R.FACTORS["capital_fit"] * 0.4)
                could = ((own[j].take(lists_of_ways) + could) * damp_of_list).max(axis=0)  # and what is fixed is damped, too, or not
                bound = by_place[j].take(at_place)
                bound += (by_field[j] + could.take(of_ways)).take(at_field)
                floor, sample = -np.inf if least is None else least, bound[::step]
                for few in (5 * page, 50 * page):  # the last of a page of those with the highest bounds is a floor for all
                    if few // step < len(sample):
                        points = scored(inside(np.flatnonzero(bound >= _last(sample, max(1, few // step))))).max(axis=0)
                        if len(points) >= page:
                            floor = max(floor, _last(points, page))
                            break
                at = np.flatnonzero(bound >= floor - 0.01)
                at = inside(at)
                points = scored(at)
                best = _best(np.arange(len(at)), points.max(axis=0), page, floor)
                if len(best):
                    at, points = at[best], points[:, best]
                    whom.append(np.full(len(at), i)), what.append(at), relevance.append(points.max(axis=0))
                    path.append(ats[points.argmax(axis=0), at]), beyond.append(outside(at))
        if not whom:
            return pa.table({"user_id": people["user_id"][:0], "opportunity_id": offers["opportunity_id"][:0], "global_score": score[:0], "relevance": pa.array([], pa.float64()), "best_path": pa.array([], pa.string()), "beyond": pa.array([], pa.bool_())})
        whom, what = pa.array(np.concatenate(whom)), pa.array(np.concatenate(what))
        return pa.table({
            "user_id": people["user_id"].take(whom), "opportunity_id": offers["opportunity_id"].take(what), "global_score": offers["global_score"].take(what),
            "relevance": np.concatenate(relevance), "best_path": pa.array(names, pa.string()).take(pa.array(np.concatenate(path))), "beyond": np.concatenate(beyond),
        })

    return of_cell


def for_you(users: DataFrame, offers: DataFrame, page: int = 20, include_outside: bool = False, least_relevance: float | None = None) -> DataFrame:
    """relevance.for_you() of all pairs. Where a factor or the ways in have too many kinds for lists, pairs are formed."""
    people, offers_, _, _, stored = R._sides(users, offers)
    names = sorted(r[0] for r in stored.select(F.explode("__ways.path")).distinct().limit(R.WAYS + 1).collect())
    if not names or len(names) > R.WAYS or not set(KINDS) <= set(offers_.columns):
        return R.for_you(R.relevance(users, offers, ("global_score",)), page, include_outside, least_relevance)
    place = {n: i for i, n in enumerate(names)}
    totals = F.transform(R._ways(F.array(*map(F.lit, names))), lambda w: R._way_points(w)["total"])
    left = kept(people.select("user_id", *OF_USER, *[c(x) for x in LISTS.values() if x != "__way_totals"], totals.alias("__way_totals")), "feed")
    right = offers_.withColumns({"__ats": F.transform("__ways", lambda w: R._of(place, w["path"])), "__needs": F.transform("__ways", R._need), "__damps": c("__ways.damp")})
    right = kept(right.select("opportunity_id", *OF_OFFER), "feed")
    n, m = left.count(), right.count()
    n, m = max(1, -(-n // USERS), min(-(-n // FEW), 4 * left.sparkSession.sparkContext.defaultParallelism)), max(1, -(-m // OFFERS))
    deal = lambda by, k: F.pmod(F.xxhash64(by), F.lit(k)).cast("int")
    left = left.withColumn("__u", deal("user_id", n)).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(n * m, "__u", "__o")
    right = right.withColumn("__o", deal("opportunity_id", m)).withColumn("__u", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n * m, "__u", "__o")
    types = {f.name: f.dataType.simpleString() for d in (users, offers) for f in d.schema}
    schema = f"user_id {types['user_id']}, opportunity_id {types['opportunity_id']}, global_score {types['global_score']}, relevance double, best_path string, beyond boolean"
    cells = left.groupBy("__u", "__o").cogroup(right.groupBy("__u", "__o"))
    return R.for_you(cells.applyInArrow(pages(names, page, include_outside, least_relevance), schema).withColumns({"place": F.lit(None).cast("int"), "show_outside_profile": F.lit(True)}), page)
