"""Keys, meters, grids, sections and voice leading over tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation
from ..functions.pitch import key_templates
from .temporal import steady_grid

# Voices from high to low with their ranges, the wider spacing below, weights of their moves.
VOICES = ("s", "a", "t", "b")
RANGES = {"s": (60, 81), "a": (55, 74), "t": (48, 69), "b": (40, 62)}
SPACING = {("s", "a"): 12, ("a", "t"): 12, ("t", "b"): 24}
LEAPS = {"s": 9, "a": 9, "t": 9, "b": 12}
MOVES = {"s": 1.2, "a": 1.0, "t": 1.0, "b": 0.8}
PAIRS = [(x, y) for k, x in enumerate(VOICES) for y in VOICES[k + 1 :]]


def detect_key(profile: DataFrame, by: Sequence[str], degree: str, weight: str) -> DataFrame:
    """Best and second key of a 12-bin profile by correlation with 24 templates, and a confidence."""
    t = key_templates(profile.sparkSession)
    r = profile.join(F.broadcast(t), profile[degree] == t["degree"]).groupBy(*by, "key", "mode").agg(F.round(correlation(F.col(weight).cast("double"), t["weight"]), 6).alias("r"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("r"), F.desc("key"), F.desc("mode")))
    top = r.withColumn("_k", rank).filter("_k <= 2").groupBy(*by).agg(*(F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("key", "mode", "r")))
    return top.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("r1") - F.col("r2")) * 4 + F.col("r1"))), 6))


def meter(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Beats per bar (4 or 3), the downbeat's phase and the contrast: the phase that stands out most; 4 of a tie."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("beats", F.explode(F.array(F.lit(4), F.lit(3))))
    phases = at.groupBy(*by, "beats", F.pmod("_i", "beats").alias("phase")).agg(F.avg(value).alias("_m"))
    per = Window.partitionBy(*by, "beats")
    stood = phases.withColumn("contrast", F.round(F.max("_m").over(per) - F.avg("_m").over(per), 9)).withColumn("_r", F.row_number().over(per.orderBy(F.desc("_m"), "phase"))).filter("_r = 1")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("contrast"), F.desc("beats")))
    return stood.withColumn("_b", best).filter("_b = 1").select(*by, "beats", "phase", "contrast")


def drift(df: DataFrame, by: Sequence[str], order: Sequence[str], t: str) -> DataFrame:
    """period (the median step), steps and drift_ms: how far the beats leave the constant grid; none under four beats."""
    w = Window.partitionBy(*by).orderBy(*order)
    steps = df.withColumn("_d", F.col(t) - F.lag(t).over(w)).withColumn("_i", F.row_number().over(w) - 1)
    base = steps.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("period"), F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("beats"))
    off = F.max(F.abs(F.col(t) - (F.col("first") + F.col("_i") * F.col("period")))) * 1000
    return steps.join(base, list(by)).filter("beats >= 4").groupBy(*by, "period", "first", "last", "beats").agg(off.alias("drift_ms"))


def grid(spans: DataFrame, beats: int) -> DataFrame:
    """Constant beats over [first, last], every beats-th a downbeat."""
    return steady_grid(spans, "first", "last", "period").withColumn("is_downbeat", F.pmod("k", F.lit(beats)) == 0)


def click_events(beats: DataFrame, by: Sequence[str], t: str, downbeat: Column, bars: int, per_bar: int, subdivision: int = 1) -> DataFrame:
    """Click events (accent, normal, sub or count_in) with a count-in of whole bars before the first beat, and the offset it takes;
    subdivision: the parts of a usual step of which all but the first get a sub."""
    w = Window.partitionBy(*by).orderBy(t)
    shaped = beats.withColumn("_i", F.row_number().over(w)).withColumn("_step", F.lead(t).over(w) - F.col(t))
    start = shaped.groupBy(*by).agg(F.min(t).alias("_first"), F.percentile("_step", F.lit(0.5)).alias("_p"))
    n = bars * per_bar
    counted = start.filter("_p is not null").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*by, (F.col("_first") - F.col("_p") * (n - F.col("_k"))).alias("at"), F.when(F.pmod("_k", F.lit(per_bar)) == 0, "count_in_accent").otherwise("count_in").alias("kind"))
    own = shaped.select(*by, F.col(t).alias("at"), F.when(downbeat, "accent").otherwise("normal").alias("kind"))
    every = own.unionByName(counted)
    if subdivision > 1:
        parts = F.explode(F.array(*(F.lit(k / subdivision) for k in range(1, subdivision))))
        every = every.unionByName(shaped.join(start, list(by)).select(*by, F.col(t).alias("_t"), "_p", parts.alias("_x")).select(*by, (F.col("_t") + F.col("_p") * F.col("_x")).alias("at"), F.lit("sub").alias("kind")).filter("at is not null"))
    offset = every.groupBy(*by).agg(F.greatest(F.lit(0.0), -(F.min("at") - 0.15)).alias("offset"))
    return every.join(offset, list(by)).withColumn("at", F.col("at") + F.col("offset"))


def label_segments(runs: DataFrame, by: Sequence[str], cluster: str, energy: str, start: str, end: str) -> DataFrame:
    """Section labels of runs of clusters: the chorus is the most repeated and loudest cluster, the verse the most
    repeated and longest of the others; the ends are intro and outro unless they are either; what comes once is a bridge."""
    stats = runs.groupBy(*by, cluster).agg(F.count("*").alias("_n"), F.round(F.avg(energy), 6).alias("_e"), F.sum(F.col(end) - F.col(start)).alias("_span"))
    per = Window.partitionBy(*by)
    multiple = stats.withColumn("_many", F.max(F.when(F.col("_n") >= 2, 1).otherwise(0)).over(per))
    fit = F.when((F.col("_many") == 0) | (F.col("_n") >= 2), 1).otherwise(0)
    first = multiple.withColumn("_c", F.row_number().over(per.orderBy(fit.desc(), F.desc("_n"), F.desc("_e"), F.desc(cluster))))
    rest = first.withColumn("_v", F.when(F.col("_c") > 1, F.row_number().over(per.orderBy(F.when(F.col("_c") > 1, 0).otherwise(1), F.desc("_n"), F.desc("_span"), F.desc(cluster)))))
    at = Window.partitionBy(*by).orderBy(start)
    placed = runs.withColumn("_i", F.row_number().over(at)).withColumn("_size", F.count("*").over(per)).join(rest.select(*by, cluster, "_n", "_c", "_v"), [*by, cluster])
    label = (
        F.when(F.col("_c") == 1, "chorus").when((F.col("_i") == 1) & ~F.coalesce(F.col("_v") == 1, F.lit(False)), "intro").when((F.col("_i") == F.col("_size")) & ~F.coalesce(F.col("_v") == 1, F.lit(False)), "outro")
        .when((F.col("_n") == 1) & (F.coalesce(F.col("_v"), F.lit(0)) != 1), "bridge").otherwise("verse")
    )
    return placed.withColumn("label", label).drop("_i", "_size", "_n", "_c", "_v")


def violations(chords: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One row per broken rule: range, spacing, crossing, parallel fifths and octaves, leaps; resting voices break none."""
    w = Window.partitionBy(*by).orderBy(order)
    both = chords.select(*by, order, *VOICES, *(F.lead(v).over(w).alias(f"{v}_") for v in VOICES))
    broken: list[tuple[Column, str, str]] = []
    for v in VOICES:
        low, high = RANGES[v]
        broken.append(((F.col(v) < low) | (F.col(v) > high), "range", v))
        broken.append((F.abs(F.col(f"{v}_") - F.col(v)) > LEAPS[v], "leap", v))
    for (x, y), most in SPACING.items():
        broken.append((F.col(x) - F.col(y) > most, "spacing", x + y))
        broken.append((F.col(x) < F.col(y), "crossing", x + y))
    for x, y in PAIRS:
        dx, dy = F.col(f"{x}_") - F.col(x), F.col(f"{y}_") - F.col(y)
        same = (dx != 0) & (dy != 0) & (F.signum(dx.cast("double")) == F.signum(dy.cast("double")))
        for interval, rule in ((7, "fifths"), (0, "octaves")):
            broken.append((same & (F.pmod(F.col(x) - F.col(y), F.lit(12)) == interval) & (F.pmod(F.col(f"{x}_") - F.col(f"{y}_"), F.lit(12)) == interval), rule, x + y))
    found = F.array(*(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(voices).alias("voices"))) for test, rule, voices in broken))
    return both.withColumn("x", F.explode(F.filter(found, lambda f: f.isNotNull()))).select(*by, order, "x.rule", "x.voices")


def voicings(spark: SparkSession, classes: Sequence[int], root: int, third: int, soprano: int | None = None) -> DataFrame:
    """All four-voice placements of a chord in range: chord tones, spacing, no crossing, the root there, the third not twice.

    Voices are joined one by one on what their spacing allows, so no product of all ranges is built."""
    tones = {v: [p for p in range(lo, hi + 1) if p % 12 in classes and (v != "s" or soprano is None or p == soprano)] for v, (lo, hi) in RANGES.items()}
    out = None
    for v in VOICES:
        one = spark.createDataFrame([(p, p // 12) for p in tones[v]], f"{v} int, _o{v} int")
        if out is None:
            out = one.drop("_os")
            continue
        above = VOICES[VOICES.index(v) - 1]
        most = SPACING[above, v]
        # a pitch below is at most `most` under the one above: listed by octave, the join is on equal octaves
        near = out.withColumn("_o", F.explode(F.sequence(F.floor((F.col(above) - most) / 12), F.floor(F.col(above) / 12))))
        out = near.join(one, (F.col("_o") == F.col(f"_o{v}").cast("long")) & (F.col(v) <= F.col(above)) & (F.col(above) - F.col(v) <= most)).drop("_o", f"_o{v}")
    has = lambda p: reduce(lambda a, v: a + F.when(F.pmod(F.col(v), F.lit(12)) == p, 1).otherwise(0), VOICES, F.lit(0))
    return out.filter((has(root) >= 1) & (has(third) <= 1))


def transition(prev: str, nxt: str) -> tuple[Column, Column]:
    """Whether a move between two voicings (column prefixes) is legal, and its cost."""
    legal, cost, held = F.lit(True), F.lit(0.0), F.lit(0)
    for v in VOICES:
        d = F.col(f"{nxt}{v}") - F.col(f"{prev}{v}")
        legal = legal & (F.abs(d) <= LEAPS[v])
        cost = cost + MOVES[v] * F.abs(d)
        held = held + F.when(d == 0, 1).otherwise(0)
    for x, y in PAIRS:
        dx, dy = F.col(f"{nxt}{x}") - F.col(f"{prev}{x}"), F.col(f"{nxt}{y}") - F.col(f"{prev}{y}")
        for interval in (7, 0):
            parallel = (dx != 0) & (dy != 0) & (F.signum(dx.cast("double")) == F.signum(dy.cast("double"))) & (F.pmod(F.col(f"{prev}{x}") - F.col(f"{prev}{y}"), F.lit(12)) == interval) & (F.pmod(F.col(f"{nxt}{x}") - F.col(f"{nxt}{y}"), F.lit(12)) == interval)
            legal = legal & ~parallel
    return legal, cost - 0.5 * held


def cheapest_chain(layers: DataFrame, order: str, nodes: list[str], length: int, move, near: tuple[str, int], node_cost: Column | None = None) -> DataFrame:
    """The cheapest path through layers 0 .. length - 1: cost and path (voicings as text); no row if there is none.

    One join and one minimum per layer; the first in order of voices of equal ones. near: a node column and the
    most that it moves by, on whose octaves the layers are joined, so that no product of layers is built."""
    lead, reach = near
    text = F.concat_ws(",", *(F.col(n).cast("string") for n in nodes))
    own = node_cost if node_cost is not None else F.lit(0.0)
    step = layers.filter(F.col(order) == 0).select(*(F.col(n).alias(f"p_{n}") for n in nodes), F.round(own, 6).alias("cost"), text.alias("path"))
    for k in range(1, length):
        here = layers.filter(F.col(order) == k).select(*nodes, F.round(own, 6).alias("_own"), text.alias("_t")).withColumnsRenamed({n: f"n_{n}" for n in nodes})
        legal, cost = move("p_", "n_")
        low, high = F.floor((F.col(f"p_{lead}") - reach) / 12), F.floor((F.col(f"p_{lead}") + reach) / 12)
        pairs = step.withColumn("_o", F.explode(F.sequence(low, high))).join(here.withColumn("_b", F.floor(F.col(f"n_{lead}") / 12)), (F.col("_o") == F.col("_b")) & legal)
        best = pairs.groupBy(*(f"n_{n}" for n in nodes)).agg(F.min(F.struct(F.round(F.col("cost") + cost + F.col("_own"), 6).alias("cost"), F.concat("path", F.lit(" "), "_t").alias("path"))).alias("m"))
        step = best.select(*(F.col(f"n_{n}").alias(f"p_{n}") for n in nodes), "m.cost", "m.path")
    return step.groupBy().agg(F.min(F.struct("cost", "path")).alias("m")).filter("m is not null").select("m.cost", "m.path")


def style(chords: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and spread of the soprano and of the three spacings, and how often neighbours sing the same note."""
    spaces = {"s": F.col("s"), "sa": F.col("s") - F.col("a"), "at": F.col("a") - F.col("t"), "tb": F.col("t") - F.col("b")}
    unison = F.avg(F.when((F.col("s") == F.col("a")) | (F.col("a") == F.col("t")) | (F.col("t") == F.col("b")), 1.0).otherwise(0.0)) * 100
    return chords.groupBy(*by).agg(*(F.avg(c.cast("double")).alias(f"mean_{n}") for n, c in spaces.items()), *(F.stddev_pop(c.cast("double")).alias(f"sd_{n}") for n, c in spaces.items()), unison.alias("unison_pct"))


def singability(chords: DataFrame, by: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Per voice, in percent: steps and leaps of its moves, notes at the edges of its range, and rests on a note.

    Voices stay side by side until their shares are known: a chord is one row."""
    w = Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))
    moved = chords.select(*by, *VOICES, *(F.abs(F.col(v) - F.lag(v).over(w)).alias(f"_{v}") for v in VOICES))
    pct = lambda c: F.round(100 * F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)

    def shares(v: str) -> list[Column]:
        p, d, (low, high) = F.col(v), F.col(f"_{v}"), RANGES[v]
        edge = 0.15 * (high - low)
        rules = {"step_pct": F.when(d > 0, d <= 2), "leap_pct": F.when(d > 0, d > 5), "edge_pct": (p <= low + edge) | (p >= high - edge), "static_pct": F.when(d.isNotNull(), d == 0)}
        return [pct(c).alias(f"{v}_{name}") for name, c in rules.items()]

    names = ("step_pct", "leap_pct", "edge_pct", "static_pct")
    wide = moved.groupBy(*by).agg(*(c for v in VOICES for c in shares(v)))
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("voice"), *(F.col(f"{v}_{n}").alias(n) for n in names)) for v in VOICES))).alias("x")
    return wide.select(*by, long).select(*by, "x.*")
