"""What the pages above the feed choose and count: filters, cohorts, previews, due ranks, roll-ups and score breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions.geo import great_circle_km
from tessaria.functions.text import fold
from tessaria.operators import feed
from tessaria.operators.joins import within_km_join

#: Occupied states, and how near the sea each grade asks for. (Fixed values.)
OCCUPIED = ("tenanted", "occupied_illegally")
BEACH_GRADES = {"frontline": ("frontline",), "sea_view": ("frontline", "sea_view"), "near_beach": ("frontline", "sea_view", "near_beach")}
#: Stems of portal labels and the types they stand for; the longest that a label contains counts. (Fixed values.)
TYPE_STEMS = (
    ("atico", "atico"),
    ("piso", "piso"),
    ("chalet", "chalet"),
    ("local", "local"),
    ("nave", "nave"),
    ("garaje", "garaje"),
    ("plaza de garaje", "garaje"),
    ("terreno", "terreno"),
    ("suelo", "terreno"),
    ("edificio", "edificio"),
)
#: Kilometres within which another area's search may stand in. (Fixed value.)
AREA_KM = 25.0


def _true(c: Column) -> Column:
    """Unknown is no pass."""
    return F.coalesce(c, F.lit(False))


def feed_filters(options: Mapping[str, object], warn: Sequence[str] = ()) -> Column:
    """All filters of the feed that are set. Columns: sources (array of enabled sources with an active listing), occupancy,
    condition, severity, below (share below the market), feedback, caveats and flags (arrays, null: never assessed), beach,
    heritage, vpo, is_new, first_seen. A value that was never assessed passes no filter on it.

    Options: source, occupancy (occupied, free), condition, severity, least_below, show_rejected, feedback, caveat, flag,
    beach (a grade of BEACH_GRADES), heritage, vpo (either way), alerts (either way), only_new, new_since.
    """
    o = dict(options)
    col, tests = F.col, []
    on = lambda name: o.get(name) is not None
    if on("source"):
        tests.append(F.array_contains("sources", F.lit(o["source"])))
    if on("occupancy"):
        tests.append(col("occupancy").isin(*OCCUPIED) if o["occupancy"] == "occupied" else col("occupancy") == "vacant")
    for name, column in (("condition", "condition"), ("severity", "severity"), ("feedback", "feedback"), ("vpo", "vpo")):
        if on(name):
            tests.append(col(column) == F.lit(o[name]))
    if on("least_below"):
        tests.append(col("below") >= o["least_below"])
    if not o.get("show_rejected"):
        tests.append(~col("feedback").eqNullSafe(F.lit("reject")))
    for name, column in (("caveat", "caveats"), ("flag", "flags")):
        if on(name):
            tests.append(F.array_contains(column, F.lit(o[name])))
    if on("beach"):
        tests.append(col("beach").isin(*BEACH_GRADES[o["beach"]]))
    if o.get("heritage"):
        tests.append(col("heritage"))
    if on("alerts"):
        # either list with evidence is an alert; none is only known once both were assessed
        alert = F.when(col("flags").isNotNull(), F.size("flags") > 0)
        warned = F.when(col("caveats").isNotNull(), F.arrays_overlap("caveats", F.array(*map(F.lit, warn)) if warn else F.array().cast("array<string>")))
        tests.append((alert | warned) == F.lit(bool(o["alerts"])))
    if o.get("only_new"):
        tests.append(col("first_seen") > F.lit(o["new_since"]) if on("new_since") else col("is_new"))
    return reduce(lambda a, b: a & b, map(_true, tests), F.lit(True))


def recapture_cohort(listings: DataFrame, predicate: str, threshold: int, now: Column, candidates: bool = False) -> DataFrame:
    """Active sale listings with a url that are worth another capture, to be sorted by best_score (nulls last), fewest
    photos, newest id: id, url, photo_count, best_score. predicate: few_photos (fewer than ``threshold``), stale_capture (older than so many days, or never), or
    never_requeued (all). ``candidates``: those in a feed alone."""
    photos = F.when(F.col("photos").isNull(), 0).otherwise(F.size(F.filter("photos", lambda x: x.isNotNull())))
    test = {
        "few_photos": photos < threshold,
        "stale_capture": F.col("fetched").isNull() | (F.col("fetched") < now - F.make_dt_interval(F.lit(threshold))),
        "never_requeued": F.lit(True),
    }[predicate]
    rows = listings.filter((F.col("status") == "active") & (F.col("operation") == "sale") & F.col("url").isNotNull() & test)
    if candidates:
        rows = rows.filter("candidate")
    return rows.select("id", "url", photos.alias("photo_count"), "best_score")


def needs_verdict(entities: DataFrame, verdicts: DataFrame, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """key, missing: how many of the kinds (name to current version) an entity has no verdict of that version for; only
    entities that miss one. verdicts: key, kind, version."""
    current = reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("version") == v) for k, v in kinds.items()), F.lit(False))
    have = verdicts.filter(current).groupBy(key).agg(F.count_distinct("kind").alias("_n"))
    missing = F.lit(len(kinds)) - F.coalesce("_n", F.lit(0))
    return entities.select(key).join(have, key, "left").select(key, missing.cast("int").alias("missing")).filter("missing > 0")


def preview(rows: DataFrame, eligible: Column, missing: Column, average_cost: DataFrame, cost: str) -> DataFrame:
    """One row: eligible, reopened (eligible and without the verdict), average cost of a call, projected cost (0 without
    reopened ones, null without an average)."""
    counts = rows.agg(F.count_if(_true(eligible)).alias("eligible"), F.count_if(_true(eligible & missing)).alias("reopened"))
    one = average_cost.agg(F.avg(cost).alias("average"))  # one row beside one row
    projected = F.when(F.col("reopened") == 0, 0.0).otherwise(F.col("reopened") * F.col("average"))
    return counts.join(F.broadcast(one)).select("eligible", "reopened", "average", projected.alias("projected"))


def staleness(last: Column, window_days: float, now: Column) -> Column:
    """done, muted, due, age_days of a task: due without a run, or once the window has passed."""
    age = F.greatest(F.lit(0), F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")))
    days = F.when(last.isNotNull(), F.floor(age / 86_400_000_000))
    within = (age < int(window_days * 86_400_000_000)) if window_days > 0 else F.lit(False)
    muted = last.isNotNull() & within
    return F.struct(last.isNotNull().alias("done"), F.coalesce(muted, F.lit(False)).alias("muted"), (~F.coalesce(muted, F.lit(False))).alias("due"), days.alias("age_days"))


def due_rank(tasks: DataFrame, group: Sequence[str], portal: str, due: str) -> DataFrame:
    """portal, rank: the most due of its groups: 0 all tasks due, 1 some, 2 none."""
    per = tasks.groupBy(*group, portal).agg(F.count_if(due).alias("_due"), F.count("*").alias("_n"))
    rank = F.when(F.col("_due") == F.col("_n"), 0).when(F.col("_due") > 0, 1).otherwise(2)
    return per.groupBy(portal).agg(F.min(rank).alias("rank"))


def backlog_seconds(pending: Column, batch: int, interval: int) -> Column:
    """Seconds until a backlog is drained: the first tick comes at once. Null without a batch size."""
    if batch <= 0:
        return F.lit(None).cast("long")
    return F.when(pending <= 0, 0).otherwise((F.ceil(pending / batch) - 1) * max(0, interval)).cast("long")


def merged_groups(parts: DataFrame, key: str, sums: Sequence[str], most: Sequence[str], least: Sequence[str]) -> DataFrame:
    """Groups that were aggregated apart, merged: sums of counts; greatest and least of the values that are known."""
    return parts.groupBy(key).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums), *(F.max(c).alias(c) for c in most), *(F.min(c).alias(c) for c in least))


def ranked_news(rows: DataFrame) -> tuple[Column, ...]:
    """Order of a digest's news: below the market, flags, score, key; what is unknown counts as minus infinity."""
    low = float("-inf")
    return F.desc(F.coalesce("below", F.lit(low))), F.desc("n_flags"), F.desc(F.coalesce("score", F.lit(low))), F.desc("id")


def slug_label(slug: Column) -> Column:
    """``comprar-casa-rural`` to ``Casa rural``."""
    words = F.trim(F.regexp_replace(F.regexp_replace(slug, "^comprar-", ""), "-", " "))
    return F.when(words == "", slug).otherwise(F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 30)))


def last_segment(url: Column) -> Column:
    """Last path segment that is not empty, without query and fragment; null if there is none."""
    parts = F.filter(F.split(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def canonical_type(label: Column) -> Column:
    """The type whose longest stem a label contains, accents aside; null for others."""
    low = F.trim(fold(label))
    ordered = sorted(TYPE_STEMS, key=lambda x: -len(x[0]))
    return F.coalesce(*(F.when(low.contains(stem), name) for stem, name in ordered))


def search_tiers(tasks: DataFrame, overrides: DataFrame, examples: DataFrame, max_lat: float = 60.0) -> DataFrame:
    """Where each task's search comes from: task, template, tier. tasks: task, portal, section, place, lat, lon; overrides:
    portal, section, template; examples: portal, section, place, lat, lon, example, template. First an override, then the
    first example (least ``example``) of the same place, then the nearest one within AREA_KM, else none (``default``)."""
    own = overrides.groupBy("portal", "section").agg(F.min("template").alias("_override"))
    same = examples.groupBy("portal", "section", "place").agg(F.min_by("template", "example").alias("_exact"))
    settled = tasks.join(own, ["portal", "section"], "left").join(same, ["portal", "section", "place"], "left")
    # only what neither has settled looks around, and of the examples at one point the first stands for all
    open_ = settled.filter("_override IS NULL AND _exact IS NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("task", "portal", "section", "lat", "lon")
    spots = examples.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("portal", "section", "lat", "lon").agg(F.min_by("template", "example").alias("template"), F.min("example").alias("example"))
    pairs = within_km_join(open_, spots, AREA_KM, ("portal", "section"), max_lat=max_lat)
    km = F.round(great_circle_km("l.lat", "l.lon", "r.lat", "r.lon"), 6)
    near = pairs.groupBy(F.col("l.task").alias("task")).agg(F.min_by("r.template", F.struct(km, F.col("r.example"))).alias("_near"))
    rows = settled.join(near, "task", "left")
    tier = F.when(F.col("_override").isNotNull(), "override").when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "near").otherwise("default")
    return rows.select("task", F.coalesce("_override", "_exact", "_near").alias("template"), tier.alias("tier"))


def confidence_tier(has_base: Column, signals: Column) -> Column:
    return F.when(~has_base, "baja").when(signals >= 3, "alta").when(signals >= 1, "media").otherwise("baja")


#: Score that is shown as 100: a full base score and all boosts.
CEILING = 1 + feed.MARKET_CAP * feed.MARKET_WEIGHT + feed.DISTRESS_CAP * feed.DISTRESS_WEIGHT + 3 * feed.BEACH_WEIGHT + feed.TOURIST_WEIGHT + feed.TIMING_CAP


def _terms() -> list[tuple[str, Column, Column]]:
    """Name, boost and whether there is data of each term of an investor score; the two timing terms shrink together to their cap."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    days, drop = zero("days") / feed.DAYS_FULL * feed.DAYS_WEIGHT, zero("drop") / feed.DROP_FULL * feed.DROP_WEIGHT
    timing = days + drop
    scale = F.when(timing > 0, F.least(timing, F.lit(feed.TIMING_CAP)) / timing).otherwise(0.0)
    market = F.least(F.greatest(zero("below"), F.lit(0.0)), F.lit(feed.MARKET_CAP)) * feed.MARKET_WEIGHT
    return [
        ("base", zero("base"), F.col("base").isNotNull()),
        ("below_market", market, F.col("below").isNotNull()),
        ("distress", F.least(zero("distress"), F.lit(float(feed.DISTRESS_CAP))) * feed.DISTRESS_WEIGHT, zero("distress") > 0),
        ("beach", zero("beach") * feed.BEACH_WEIGHT, zero("beach") > 0),
        ("tourist", F.when(F.col("tourist"), feed.TOURIST_WEIGHT).otherwise(0.0), _true(F.col("tourist"))),
        ("days_on_market", days * scale, F.col("days").isNotNull()),
        ("price_drop", drop * scale, F.col("drop").isNotNull()),
    ]


def score_terms(df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns to keep, and term, points (not yet rounded), has_data of an investor score: base, below_market,
    distress, beach, tourist, days_on_market, price_drop."""
    structs = [F.struct(F.lit(name).alias("term"), (boost / CEILING * 100).alias("points"), has.alias("has_data")) for name, boost, has in _terms()]
    return df.select(key, *keep, F.explode(F.array(*structs)).alias("t")).select(key, *keep, "t.term", "t.points", "t.has_data")


def with_confidence(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the confidence of its key's score. Rows meet as they are, before their terms are written out: one row
    each is shuffled, not seven, and no table of all keys is joined or broadcast. Rows of one key count together."""
    own = Window.partitionBy(key)
    base, *others = [has for _, _, has in _terms()]
    signals = F.sum(reduce(lambda a, b: a + b, (has.cast("int") for has in others))).over(own)
    return df.withColumn("confidence", confidence_tier(F.bool_or(base).over(own), signals))


def table_order(cell: str, falling: bool = False) -> tuple[Column, ...]:
    """Sort of a table by one column of texts: nulls last either way, numbers by value before texts, texts by Spanish collation
    (accents after plain letters, ñ after n)."""
    c = F.col(cell)
    number = F.expr(f"try_cast(nullif(`{cell}`, '') AS double)")
    turn = (lambda x: x.desc_nulls_last()) if falling else (lambda x: x.asc_nulls_last())
    return (c.isNull().asc(), number.isNull().asc() if not falling else number.isNull().desc(), turn(number), turn(F.collate(c, "es")))


def profile_cards(profiles: DataFrame, states: DataFrame, listings: DataFrame, disabled: DataFrame, feedback: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row per profile (profile_id, anchor, rent: euros a square metre and month or null): matched_count, new_count, accepted
    and rejected, min, median and max of the cheapest active sales, cold_start and trained, median gross yield in percent
    (null without a rent), flagged_count, thumbnails (photos of the four best: structs property_id, photo, best first).

    states: profile_id, property_id, matched, score, score_kind, m2; listings: property_id, source, active_sale, active, price,
    first_seen, photos; disabled: source; feedback (current): profile_id, property_id, kind; flagged: property_id. Every
    figure is an aggregate at the profile's grain, joined once; nothing is looked up row by row.
    """
    off = listings.join(disabled.select("source", F.lit(True).alias("_off")).distinct(), "source", "left")
    photo = F.get(F.filter("photos", lambda x: x.isNotNull()), F.lit(0))
    per = off.groupBy("property_id").agg(
        F.min(F.when(F.col("active_sale"), F.col("price"))).alias("price"),
        F.min(F.when(F.col("_off").isNull(), F.col("first_seen"))).alias("first_seen"),
        F.min(F.when(F.col("active") & photo.isNotNull(), F.struct("source", photo.alias("photo"))))["photo"].alias("photo"),
    )
    rows = states.filter("matched").join(per, "property_id", "left").join(feedback, ["profile_id", "property_id"], "left").join(profiles, "profile_id")
    rows = rows.join(flagged.select("property_id", F.lit(True).alias("_flag")).distinct(), "property_id", "left")
    yields = F.when((F.col("price") > 0) & (F.col("m2") > 0), F.col("rent") * 12 * F.col("m2") / F.col("price") * 100)
    stats = rows.groupBy("profile_id").agg(
        F.count("*").alias("matched_count"),
        F.count_if((F.col("first_seen") > F.col("anchor")) & ~F.col("kind").eqNullSafe(F.lit("reject"))).alias("new_count"),
        F.min("price").alias("min_price"),
        F.percentile("price", 0.5).alias("median_price"),
        F.max("price").alias("max_price"),
        F.count_if(F.col("score_kind") == "cold_start").alias("cold_start_count"),
        F.count_if(F.col("score_kind") == "trained").alias("trained_count"),
        F.percentile(yields, 0.5).alias("yield_median"),
        F.count("_flag").alias("flagged_count"),
    )
    w = Window.partitionBy("profile_id").orderBy(F.desc_nulls_last("score"), F.desc("property_id"))
    best = rows.select("profile_id", "property_id", "photo", F.row_number().over(w).alias("_rn")).filter("_rn <= 4")
    pictures = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "property_id", "photo"))), lambda x: F.struct(x["property_id"].alias("property_id"), x["photo"].alias("photo")))
    verdicts = feedback.groupBy("profile_id").agg(F.count_if(F.col("kind") == "accept").alias("accepted_count"), F.count_if(F.col("kind") == "reject").alias("rejected_count"))
    out = profiles.select("profile_id").join(stats, "profile_id", "left").join(verdicts, "profile_id", "left").join(best.groupBy("profile_id").agg(pictures.alias("thumbnails")), "profile_id", "left")
    counts = ("matched_count", "new_count", "accepted_count", "rejected_count", "cold_start_count", "trained_count", "flagged_count")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def market_signals(ranked: DataFrame, least_move: float, most_move: float) -> DataFrame:
    """profile, id, below, change (the price move since the anchor, where it is within the band), direction (up, down)."""
    usable = F.abs("change").between(least_move, most_move)
    change = F.when(usable, F.col("change"))
    return ranked.select("profile", "id", "below", change.alias("change"), F.when(change > 0, "up").when(change < 0, "down").alias("direction"))


#: Rows that a section of a digest shows at most. (Fixed value.)
SECTION_LIMIT = 25


def digest_anchors(profiles: DataFrame, runs: DataFrame, kind: str, now: Column) -> DataFrame:
    """profile, since: the newest run of a kind that was sent, else a day before ``now``. runs: profile, kind, sent, at."""
    last = runs.filter((F.col("kind") == kind) & F.col("sent")).groupBy("profile").agg(F.max("at").alias("_at"))
    return profiles.select("profile").join(last, "profile", "left").select("profile", F.coalesce("_at", now - F.expr("INTERVAL 1 DAY")).alias("since"))


def digest_sections(matched: DataFrame, anchors: DataFrame, moves: DataFrame, status: DataFrame, relisted: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """profile, section (drop, status, relisted), place, property_id, at, value of each profile's digest since its anchor.

    matched: profile, property_id; moves: property_id, listing, at, price, previous; status: property_id, listing, at, status;
    relisted: property_id, relisted_at, fall. Drops and changes come newest first; of properties withdrawn since the anchor the
    first ``limit`` by id are looked at, and those that came back cheaper shown by fall.
    """
    pool = matched.join(anchors, "profile")

    def section(rows: DataFrame, name: str, order: tuple[Column, ...], value: Column, at: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("profile").orderBy(*order))
        return rows.withColumn("place", place).filter(F.col("place") <= limit).select("profile", F.lit(name).alias("section"), "place", "property_id", F.col(at).alias("at"), value.cast("double").alias("value"))

    since = F.col("at") >= F.col("since")
    newest = (F.desc("at"), F.asc("property_id"), F.asc("listing"))
    drops = pool.join(moves.filter("price < previous"), "property_id").filter(since)
    changes = pool.join(status.filter(F.col("status").isin("sold", "withdrawn")), "property_id").filter(since)
    gone = pool.join(status.filter(F.col("status").isin("withdrawn", "expired")), "property_id").filter(since).select("profile", "property_id").distinct()
    looked = gone.withColumn("_n", F.row_number().over(Window.partitionBy("profile").orderBy("property_id"))).filter(F.col("_n") <= limit).drop("_n")
    back = looked.join(relisted, "property_id")
    return (
        section(drops, "drop", newest, (F.col("previous") - F.col("price")) / F.col("previous"), "at")
        .unionByName(section(changes, "status", (*newest, F.asc("status")), F.when(F.col("status") == "sold", 1).otherwise(0), "at"))
        .unionByName(section(back, "relisted", (F.desc("fall"), F.asc("property_id")), F.col("fall"), "relisted_at"))
    )
