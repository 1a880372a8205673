"""Simulated items, users, queries, events and judgements, from ``settings.Simulation``.

Every value is a hash of the seed, a purpose and the row's number, so tables do not depend on partitions and a lost task
gives the same rows again.  Attributes follow from the number alone: a session works out its user, query and items in
place, and no step but the judgements joins or shuffles.  Shuffled round-robin assignment is an affine permutation of the
numbers; popularity is given by rank inside a category, so that a draw weighted by popularity is a lookup.  Up to 10^9
items, users and queries each.

Defined results: event ids rise with session and time but have gaps; a category without brands has one called Generic; a
category without subcategories has itself as one, without a price range prices lie from 1 to 100.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.judgements import grade, relevance
from .files import SCHEMAS
from .settings import Simulation

#: Primes above all numbers of rows, so that each is coprime to every one of them.
PRIMES = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033, 1_000_000_087, 1_000_000_093, 1_000_000_097, 1_000_000_103)
DAY = 86400.0
STEPS = 128

ADJECTIVES = ["Sturdy", "Light", "Quiet", "Bright", "Handy", "Slim", "Warm", "Swift"]
# {t} title, {s} subcategory, {c} category
DESCRIPTIONS = ["{t}: well-made {s} for {c} lovers.", "{t} is {s} that lasts, from our {c} range.", "Good {s} at a fair price: {t}.", "{t}, a favourite among {c} buyers."]
# {b} brand, {s} subcategory, {l} the same in small letters, {c} category: text and intent of a query
QUERIES = [
    ("{b} {s}", "The shopper wants {s} made by {b} in {c}"),
    ("best {l}", "The shopper compares the best {s} in {c}"),
    ("affordable {l} for daily use", "The shopper looks for affordable {s} in {c}"),
    ("{b} {l} review", "The shopper reads reviews of {b} {s}"),
]


def filled(text: Column, **values: Column) -> Column:
    """``text`` with ``{name}`` replaced by each value."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def listed(values: list) -> Column:
    """A constant array; as one text it stays one small expression wherever it is used."""
    kind = "string" if isinstance(values[0], str) else "bigint" if isinstance(values[0], int) else "double"
    return F.split(F.lit("\x01".join(map(str, values))), "\x01").cast(f"array<{kind}>")


def at(values: list, i: Column) -> Column:
    """``values[i]``, counted from 0."""
    return F.get(listed(values), i.cast("int"))


class Lists:
    """A list of texts per group, kept as one list and its offsets."""

    def __init__(self, lists: list[list[str]]):
        self.flat, self.sizes = [x for xs in lists for x in xs], [len(xs) for xs in lists]
        self.starts = [sum(self.sizes[:g]) for g in range(len(lists))]

    def size(self, group: Column) -> Column:
        return at(self.sizes, group)

    def at(self, group: Column, i: Column) -> Column:
        return at(self.flat, at(self.starts, group) + i)


def held(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds columns that no later step plans again: they pass through a one-element ``inline``."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in values.items())))))


def div(a: Column, b) -> Column:
    return F.floor(a / b).cast("bigint")


def table_at(points: np.ndarray, x: Column) -> Column:
    """Linear interpolation of evenly spaced points over 0 to 1."""
    place = x * (len(points) - 1)
    low = F.least(F.floor(place), F.lit(len(points) - 2)).cast("int")
    values = listed([float(p) for p in points])
    return F.get(values, low) + (place - low) * (F.get(values, low + 1) - F.get(values, low))


class Deal:
    """A permutation of ``0..n-1`` whose images are dealt round-robin to ``groups`` groups."""

    def __init__(self, n: int, groups: int, key: int):
        if n > 10**9:
            raise ValueError("more than 10^9 rows")
        self.n, self.groups = n, groups
        self.factor, self.shift = PRIMES[key % len(PRIMES)] % n or 1, key * 7919 % n
        self.back = pow(self.factor, -1, n) if n > 1 else 0
        self.sizes = [len(range(g, n, groups)) for g in range(groups)]

    def place(self, i: Column) -> tuple[Column, Column]:
        """Group and place in the group."""
        slot = F.pmod(i * self.factor + self.shift, F.lit(self.n))
        return F.pmod(slot, F.lit(self.groups)), div(slot, self.groups)

    def number(self, group: Column, place: Column) -> Column:
        slot = place * self.groups + group
        return F.pmod(F.pmod(slot - self.shift, F.lit(self.n)) * self.back, F.lit(self.n))

    def size(self, group: Column) -> Column:
        return at(self.sizes, group)


class Shop:
    """Column functions of row numbers."""

    def __init__(self, cfg: Simulation):
        self.cfg, kinds = cfg, cfg.categories
        self.subs = Lists([cfg.subcategories.get(c) or [c] for c in kinds])
        self.brands = Lists([cfg.brands.get(c) or ["Generic"] for c in kinds])
        ranges = [cfg.price_ranges.get(c, [1, 100]) for c in kinds]
        self.low, self.span = [float(r[0]) for r in ranges], [float(r[1]) - float(r[0]) for r in ranges]
        n = len(kinds)
        self.items, self.queries = Deal(cfg.num_items, n, cfg.seed + 1), Deal(cfg.num_queries, n, cfg.seed + 2)
        self.users = Deal(cfg.num_users, len(cfg.activity_levels), cfg.seed + 3)
        # popularity is Beta(1.5, 5): its quantiles, and the rank that a draw weighted by popularity + 0.01 hits
        x = np.linspace(0, 1, 20_001)
        mass = np.concatenate([[0], np.cumsum((x[1:] + x[:-1]) ** 0.5 * (1 - (x[1:] + x[:-1]) / 2) ** 4)])
        share = np.linspace(0, 1, STEPS + 1)
        fine = np.interp(np.linspace(0, 1, 20_001), mass / mass[-1], x)
        weight = np.concatenate([[0], np.cumsum(fine[1:] + 0.01)])
        self.quantiles = np.interp(share, mass / mass[-1], x)
        self.weighted = np.interp(share, weight / weight[-1], np.linspace(0, 1, 20_001))
        self.turns = [PRIMES[0] % m if m > 1 else 0 for m in self.items.sizes]
        self.returns = [pow(t, -1, m) if m > 1 else 0 for t, m in zip(self.turns, self.items.sizes)]

    def u(self, purpose: str, *keys: Column) -> Column:
        """A number in [0, 1)."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(purpose), F.lit(self.cfg.seed), *keys), 11) / float(1 << 53)

    def below(self, n: Column | int, purpose: str, *keys: Column) -> Column:
        return F.floor(self.u(purpose, *keys) * n).cast("bigint")

    def normal(self, mean: float, spread: float, purpose: str, *keys: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log(1.0 - self.u(purpose, *keys)))
        return radius * F.cos(2 * math.pi * self.u(purpose + "'", *keys)) * spread + mean

    def moment(self, low: float, high: float, purpose: str, i: Column) -> Column:
        return F.timestamp_micros(((low + self.u(purpose, i) * (high - low)) * 1e6).cast("bigint"))

    def created(self, new: Column, days: int, purpose: str, i: Column) -> Column:
        """New ones in the last ``days`` days, others before."""
        cut = max(self.cfg.end - DAY * days, self.cfg.start)
        return F.when(new, self.moment(cut, self.cfg.end, purpose, i)).otherwise(self.moment(self.cfg.start, cut, purpose, i))

    def item(self, i: Column, group: Column, place: Column) -> dict[str, Column]:
        size = self.items.size(group)
        rank = F.when(size > 1, F.pmod(place * at(self.turns, group), size)).otherwise(0)
        return {
            "category": at(self.cfg.categories, group),
            "subcategory": self.subs.at(group, F.pmod(place, self.subs.size(group))),
            "brand": self.brands.at(group, F.pmod(div(place, self.subs.size(group)), self.brands.size(group))),
            "price": F.round(at(self.low, group) + at(self.span, group) * self.u("price", i), 2),
            "quality_score": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), self.normal(0.7, 0.15, "quality", i))), 4),
            "popularity_score": F.round(table_at(self.quantiles, (rank + 0.5) / size), 4),
        }

    def user(self, v: Column) -> dict[str, Column]:
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(self.cfg.categories) - 1)), lambda c: F.struct(self.u("liked", v, c).alias("u"), c.alias("c"))))
        liked = F.slice(F.transform(order, lambda x: x.c), 1, (self.below(3, "n_liked", v) + 1).cast("int"))
        brand = lambda c: self.brands.at(c, self.below(self.brands.size(c), "liked_brand", v, c))
        return {
            "groups": liked,
            "preferred_categories": F.transform(liked, lambda c: at(self.cfg.categories, c)),
            "preferred_brands": F.transform(liked, brand),
            "price_preference": at(self.cfg.price_preference_levels, self.below(len(self.cfg.price_preference_levels), "price_level", v)),
            "activity_level": at(self.cfg.activity_levels, self.users.place(v)[0]),
            "is_cold_start": v < max(1, int(self.cfg.num_users * self.cfg.cold_start_user_ratio)),
        }

    def asked(self, df: DataFrame, q: Column) -> DataFrame:
        """Adds a query's columns.  Queries of a category go through all its subcategories, brands and templates before one comes back."""
        group, place = self.queries.place(q)
        df, group = held(df, {"group": group, "place": place}), F.col("group")
        kinds = self.subs.size(group) * self.brands.size(group) * len(QUERIES)
        df = held(df, {"number": F.pmod(F.col("place") * PRIMES[1] + self.below(kinds, "template", group), kinds)})
        number = F.col("number")
        sub = self.subs.at(group, F.pmod(div(number, len(QUERIES)), self.subs.size(group)))
        brand = self.brands.at(group, div(number, self.subs.size(group) * len(QUERIES)))
        df = held(df, {"intended_category": at(self.cfg.categories, group), "s": sub, "b": brand, "kind": F.pmod(number, F.lit(len(QUERIES)))})
        fill = lambda texts: filled(at(texts, F.col("kind")), b=F.col("b"), s=F.col("s"), l=F.lower("s"), c=F.col("intended_category"))
        return held(df, {"query_text": fill([t for t, _ in QUERIES]), "semantic_intent": fill([i for _, i in QUERIES])}).drop("place", "number", "s", "b", "kind")


def named(prefix: str, i: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", i + 1)


def items(spark: SparkSession, cfg: Simulation) -> DataFrame:
    shop, i = Shop(cfg), F.col("id")
    cold = i < max(1, int(cfg.num_items * cfg.cold_start_item_ratio))
    group, place = shop.items.place(i)
    df = held(spark.range(cfg.num_items), {"group": group, "place": place})
    df = held(df, shop.item(i, F.col("group"), F.col("place")))
    df = df.withColumn("title", F.concat_ws(" ", "brand", at(ADJECTIVES, shop.below(len(ADJECTIVES), "adjective", i)), F.regexp_replace("subcategory", "s+$", "")))
    text = at(DESCRIPTIONS, shop.below(len(DESCRIPTIONS), "description", i))
    text = filled(text, t=F.col("title"), s=F.lower("subcategory"), c=F.lower("category"))
    df = df.withColumns({"item_id": named("item", i), "description": text, "is_cold_start": cold, "created_at": shop.created(cold, 30, "item_created", i)})
    return df.select(*(c.split(" ", 1)[0] for c in SCHEMAS["items"].split(", ")))


def users(spark: SparkSession, cfg: Simulation) -> DataFrame:
    shop, i = Shop(cfg), F.col("id")
    df = held(spark.range(cfg.num_users), shop.user(i)).withColumn("user_id", named("user", i))
    df = df.withColumn("created_at", shop.created(F.col("is_cold_start"), 14, "user_created", i))
    return df.select(*(c.split(" ", 1)[0] for c in SCHEMAS["users"].split(", ")))


def queries(spark: SparkSession, cfg: Simulation) -> DataFrame:
    shop, i = Shop(cfg), F.col("id")
    df = shop.asked(spark.range(cfg.num_queries), i).withColumns({"query_id": named("query", i), "created_at": shop.moment(cfg.start, cfg.end, "query_created", i)})
    return df.select(*(c.split(" ", 1)[0] for c in SCHEMAS["queries"].split(", ")))


# How often users of a level come, relative to each other, and where on a price range a preference lies.
ACTIVITY = {"low": 1.0, "medium": 3.0, "high": 8.0}
PRICE_PLACE = {"budget": 0.0, "mid_range": 0.5, "premium": 1.0}


def click_probability(cfg: Simulation, position: Column, rel: Column, cold: Column, likes_category: Column, likes_brand: Column) -> Column:
    """Falls with the position; relevance and, for users who are not new, the own categories and brands raise it; 0.85 at most."""
    boost = lambda likes: F.when(~cold & likes, cfg.preference_boost).otherwise(1.0)
    return F.least(F.lit(0.85), cfg.base_click_probability / F.pow(position, F.lit(cfg.position_decay_alpha)) * (1.0 + (cfg.relevance_boost - 1.0) * rel) * boost(likes_category) * boost(likes_brand))


def follow_probability(base: float, quality: Column) -> Column:
    """Of favourites and carts after a click."""
    return base * (0.5 + 0.5 * quality)


def purchase_probability(cfg: Simulation, quality: Column, price_place: Column, wanted_place: Column, likes_category: Column) -> Column:
    """After a cart; ``price_place`` is where the price lies in its category's range, 0 to 1; 0.7 at most."""
    near = 1.0 - F.abs(price_place - wanted_place)
    return F.least(F.lit(0.70), follow_probability(cfg.base_purchase_probability, quality) * (0.4 + 0.6 * near) * F.when(likes_category, 1.2).otherwise(1.0))


def sessions(spark: SparkSession, cfg: Simulation, shop: Shop) -> DataFrame:
    """A user, a query and a start for each session; three of ten sessions of new users are empty and left out."""
    s = F.col("id")
    weights = np.array([ACTIVITY.get(level, 1.0) * n for level, n in zip(cfg.activity_levels, shop.users.sizes)])
    bounds = [float(x) for x in np.cumsum(weights) / weights.sum()][:-1]
    level = sum(((shop.u("level", s) >= b).cast("bigint") for b in bounds), F.lit(0).cast("bigint"))
    df = held(spark.range(cfg.num_sessions), {"level": level})
    df = held(df, {"user": shop.users.number(F.col("level"), shop.below(shop.users.size(F.col("level")), "member", s))})
    df = held(df, shop.user(F.col("user"))).filter(~(F.col("is_cold_start") & (shop.u("absent", s) < 0.3)))
    df = held(df, {"stocked": F.filter("groups", lambda c: shop.queries.size(c) > 0)})
    df = held(df, {"own": F.get("stocked", shop.below(F.size("stocked"), "own_category", s).cast("int")).cast("bigint")})
    own = F.when((shop.u("own", s) < 0.7) & F.col("own").isNotNull(), shop.queries.number(F.col("own"), shop.below(shop.queries.size(F.col("own")), "own_query", s)))
    df = held(df, {"query": F.coalesce(own, shop.below(cfg.num_queries, "query", s)), "start": cfg.start + shop.u("start", s) * (cfg.end - cfg.start)})
    return shop.asked(df, F.col("query"))


def result_page(df: DataFrame, cfg: Simulation, shop: Shop) -> DataFrame:
    """Adds ``page``, the items shown in order: half of the places for the query's category, half for popular items of
    other categories, which may come twice."""
    s, group, half = F.col("id"), F.col("group"), cfg.serp_size // 2
    kinds = len(cfg.categories)
    places = F.sequence(F.lit(0), F.lit(max(half - 1, 0)))
    df = held(df, {"n": shop.items.size(group), "stride": at(list(PRIMES), shop.below(len(PRIMES), "stride", s)), "first": shop.u("first", s)})
    n = F.col("n")
    inside = F.transform(F.filter(places, lambda k: (k < n) & F.lit(half > 0)), lambda k: F.struct(group.alias("g"), F.pmod(F.col("stride") * k + F.floor(F.col("first") * n), n).alias("p"), F.lit(0.7).alias("w")))

    def other(k):
        g = F.pmod(group + 1 + shop.below(max(kinds - 1, 1), "other", s, k), F.lit(kinds))
        return F.struct(g.alias("g"), table_at(shop.weighted, shop.u("popular", s, k)).alias("r"))

    def popular(x):
        m = shop.items.size(x.g)
        place = F.when(m > 1, F.pmod(F.least(F.floor(x.r * m).cast("bigint"), m - 1) * at(shop.returns, x.g), m)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(x.g.alias("g"), place.alias("p"), F.lit(0.3).alias("w"))

    if kinds < 2 or not half:
        df = held(df, {"picks": inside})
    else:
        df = held(df, {"others": F.filter(F.transform(places, other), lambda x: shop.items.size(x.g) > 0)})
        df = held(df, {"picks": F.concat(inside, F.transform("others", popular))})

    def known(x):
        i = shop.items.number(x.g, x.p)
        return F.struct(i.alias("i"), x.g.alias("g"), x.w.alias("w"), *(c.alias(n) for n, c in shop.item(i, x.g, x.p).items()))

    def scored(x):
        rel = relevance(x.category, x.subcategory, x.brand, F.col("intended_category"), F.col("query_text"))
        return F.struct((-(rel * x.w + x.popularity_score * (1.0 - x.w))).alias("order"), rel.alias("rel"), x.alias("item"))

    df = held(df, {"known": F.transform("picks", known)})
    df = held(df, {"scored": F.transform("known", scored)})
    return held(df, {"page": F.slice(F.array_sort("scored"), 1, cfg.serp_size)})


def events(spark: SparkSession, cfg: Simulation) -> DataFrame:
    """A user scans the page from the top: each place is an impression and may be clicked, up to a number of clicks;
    favourites and carts follow a click, a purchase follows a cart, and a click may end the session."""
    shop, s = Shop(cfg), F.col("id")
    df = result_page(sessions(spark, cfg, shop), cfg, shop)

    def seen(x, k):
        item, place = x.item, (k + 1).cast("double")
        likes, likes_brand = F.array_contains("preferred_categories", item.category), F.array_contains("preferred_brands", item.brand)
        span = at(shop.span, item.g)
        where = F.when(span > 0, (item.price - at(shop.low, item.g)) / span).otherwise(0.5)
        wanted = F.coalesce(*(F.when(F.col("price_preference") == p, v) for p, v in PRICE_PLACE.items()), F.lit(0.5))
        cart = shop.u("cart", s, k) < follow_probability(cfg.base_add_to_cart_probability, item.quality_score)
        return F.struct(
            item.i.alias("i"),
            (k + 1).alias("position"),
            item.price.alias("price"),
            (shop.u("click", s, k) < click_probability(cfg, place, x.rel, F.col("is_cold_start"), likes, likes_brand)).alias("click"),
            (shop.u("leave", s, k) < cfg.post_click_stop_probability).alias("leave"),
            (shop.u("favorite", s, k) < follow_probability(cfg.base_favorite_probability, item.quality_score)).alias("favorite"),
            cart.alias("cart"),
            (cart & (shop.u("purchase", s, k) < purchase_probability(cfg, item.quality_score, where, wanted, likes))).alias("purchase"),
        )

    df = held(df, {"seen": F.transform("page", seen)})
    df = held(df, {"clicks": F.slice(F.filter("seen", lambda x: x.click), 1, cfg.max_clicks_per_request)})
    last = F.coalesce(F.array_min(F.transform(F.filter("clicks", lambda x: x.leave), lambda x: x.position)), F.lit(cfg.serp_size))
    df = held(df, {"last": last})
    df = held(df, {"clicked": F.filter(F.transform("clicks", lambda x: x.position), lambda p: p <= F.col("last"))})

    def steps(x):
        """What happens at a place, with the time that each step takes."""
        hit = F.array_contains("clicked", x.position)
        kinds = {"impression": (F.lit(True), 2.0), "click": (hit, 30.0), "favorite": (hit & x.favorite, 10.0), "add_to_cart": (hit & x.cart, 15.0), "purchase": (hit & x.purchase, 120.0)}
        made = [F.struct(F.lit(t).alias("event_type"), (shop.u(f"{t}_time", s, x.position) * most).alias("took"), x.i.alias("i"), x.position.alias("position"), x.price.alias("price"), on.alias("on")) for t, (on, most) in kinds.items()]
        return F.filter(F.array(*made), lambda e: e.on)

    df = held(df, {"steps": F.flatten(F.transform(F.filter("seen", lambda x: x.position <= F.col("last")), steps))})
    df = df.select("id", "user", "query", "query_text", "start", "steps", F.posexplode("steps").alias("n", "e"))
    passed = F.aggregate(F.slice("steps", F.lit(1), F.col("n") + 1), F.lit(0.0), lambda a, e: a + e.took)
    df = df.select("id", "user", "query", "query_text", "n", "e.*", (F.least(F.col("start") + passed, F.lit(cfg.end)) * 1e6).cast("bigint").alias("at"))
    only = lambda kind, value: F.when(F.col("event_type") == kind, value)
    return df.select(
        named("event", s * (cfg.serp_size + 4 * cfg.max_clicks_per_request) + F.col("n"), 8).alias("event_id"),
        "event_type",
        named("req", s).alias("request_id"),
        named("sess", s).alias("session_id"),
        named("user", F.col("user")).alias("user_id"),
        named("query", F.col("query")).alias("query_id"),
        "query_text",
        named("item", F.col("i")).alias("item_id"),
        F.col("position").cast("int").alias("position"),
        F.timestamp_micros("at").alias("timestamp"),
        only("click", F.greatest(F.lit(0), shop.normal(6000.0, 4000.0, "duration", s, F.col("n")).cast("int"))).alias("click_duration_ms"),
        only("add_to_cart", (shop.below(5, "quantity", s, F.col("n")) + 1).cast("int")).alias("add_to_cart_quantity"),
        only("purchase", F.round(F.col("price") * (0.8 + 0.4 * shop.u("amount", s, F.col("n"))), 2)).alias("purchase_amount"),
    )


def simulate(spark: SparkSession, cfg: Simulation) -> dict[str, DataFrame]:
    """The five base tables, each evaluated only when used; fails on settings that break a rule."""
    if cfg.problems():
        raise ValueError("; ".join(cfg.problems()))
    made = {"items": items(spark, cfg), "users": users(spark, cfg), "queries": queries(spark, cfg), "events": events(spark, cfg)}
    return made | {"qrels": grade(made["items"], made["queries"]).select("query_id", "item_id", F.col("grade").alias("relevance_grade"))}


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, value, n)``: rows of each table, events by type and judgements by grade."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), F.lit(t).alias("value"), "n") for t, df in tables.items()]
    rows += [tables[t].groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("name"), "value", "n") for t, c in (("events", "event_type"), ("qrels", "relevance_grade"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
