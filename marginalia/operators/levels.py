"""Nine chunk levels of annotated records, with one payload and one running number over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.chunks import WINDOW, era
from marginalia.operators.order import neighbours, numbered

#: The levels in the order of their numbers.
LEVELS = ("verse", "group", "poem", "manuscript", "poet", "era", "genre", "emotion", "reference")
#: Ids of a part: a group's text comes in parts, so that no group is one string however large it is.
SPAN = 100
#: Ids of a home (whole parts), whose texts lie together; bytes of text of a task.
HOME, RANGE = 10 * SPAN, 32 << 20
PAYLOAD = ("anchor_id", "poet", "manuscript", "genre", "emotions")
#: What an entry has: its id, texts' groups, years and text; its labels are a table of their own.
ENTRY = ("anchor_id", "poet", "volume", "manuscript", "start", "end", "text")
LABELS = ("genre", "emotions")


def _row(level: str, label: Column, base: Column, n: Column, lead: Column, slots: Column, home: Column, far: Column | None = None, **payload: Column) -> list[Column]:
    """The columns of a chunk; payload that a level doesn't carry is empty.  Its text is ``lead`` and the texts it names."""
    empty = {"anchor_id": F.lit(None).cast("long"), "poet": F.lit(""), "manuscript": F.lit(None).cast("long"), "genre": F.lit(""), "emotions": F.array().cast("array<string>")}
    named = [payload.get(p, empty[p]).alias(p) for p in PAYLOAD]
    places = [home.alias("_home"), slots.alias("_slots"), (F.lit(None).cast(FAR) if far is None else far).alias("_far")]
    return [F.lit(LEVELS.index(level) + 1).alias("_no"), F.lit(level).alias("level"), label.alias("_label"), base.alias("_base"), *named, n.cast("long").alias("n"), lead.alias("_lead"), *places]


#: Texts of more than one home.
FAR = "array<struct<home:long,slot:int>>"


def _parts(entries: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """Each group's records in parts of ``SPAN`` ids: keys, ``part``, ``n``, the places ``slots`` of their texts in ``home`` and the first record ``first``."""
    if least > 1:
        known = entries.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
        same = [entries[k].eqNullSafe(known[k]) for k in keys]
        entries = entries.join(known, same, "left_semi")
    return entries.groupBy(*keys, "home", F.floor(F.col("anchor_id") / SPAN).alias("part")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("slot")).alias("slots"), F.min_by(F.struct(*PAYLOAD), "slot").alias("first")
    )


def _headed(title: Column, n: Column) -> Column:
    """A header with the number of records, before their texts."""
    return F.concat(F.lit("["), title, F.lit("] "), n.cast("string"), F.lit(" records"), F.when(n > 0, " || ").otherwise(""))


def _texts(placed: DataFrame, entries: DataFrame, tasks: int) -> DataFrame:
    """The chunks with their ``text`` in place of what names it.

    Texts are dealt once, by home, and chunks that lie in one home meet them there; of the few windows that reach over two or
    more, only their own texts go on.
    """
    here = F.sort_array(F.collect_list(F.struct("anchor_id", "mark", "text")))  # HOME at most, as slots count them
    homes = entries.select("home", "anchor_id", "mark", "text").repartition(tasks, "home").groupBy("home").agg(F.transform(here, lambda x: x["text"]).alias("here"))
    chunk = [c for c in placed.columns if c not in ("_home", "_slots", "_far")]
    bare = placed.where("_slots IS NULL AND _far IS NULL").select(*(c for c in chunk if c != "_lead"), F.col("_lead").alias("text"))

    whole = placed.where("_slots IS NOT NULL").withColumnRenamed("_home", "home").repartition(tasks, "home")
    asked = whole.groupBy("home", F.floor(F.get("_slots", 0) / SPAN).alias("_some"), "level").agg(F.collect_list(F.struct(*(c for c in chunk if c != "level"), "_slots")).alias("_asked"))
    glue = F.when(F.col("level") == "group", "\n").when(F.col("level") == "poem", " | ").otherwise(" ||| ")
    joined = lambda c: F.call_function("array_join", F.transform(c["_slots"], lambda i: F.get("here", i)), glue)
    told = F.transform("_asked", lambda c: F.struct(*(c[x].alias(x) for x in chunk if x not in ("level", "_lead")), F.concat(c["_lead"], joined(c)).alias("text")))
    near = asked.join(homes, "home").select("level", F.inline(told)).select(*bare.columns)

    split = placed.where("_far IS NOT NULL")
    pieces = split.select("seq", F.posexplode("_far").alias("_k", "_at")).select("seq", "_k", "_at.home", "_at.slot")
    wanted = pieces.repartition(tasks, "home").groupBy("home").agg(F.collect_list(F.struct("seq", "_k", "slot")).alias("_asked"))
    sent = wanted.join(homes, "home").select(F.inline(F.transform("_asked", lambda c: F.struct(c["seq"].alias("seq"), c["_k"].alias("_k"), F.get("here", c["slot"]).alias("_t")))))
    runs = sent.repartition(tasks, "seq").groupBy("seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]), "\n").alias("text"))
    return bare.unionByName(near).unionByName(split.join(runs, "seq").select(*bare.columns))


def nine_levels(entries: DataFrame, labels: DataFrame, manuscripts: DataFrame, references: DataFrame) -> DataFrame:
    """``seq, chunk_id, level, part``, the payload, ``n`` and ``text`` of all levels.

    ``entries`` has the columns ``ENTRY``, distinct ids, and counts only with a text; ``labels`` is (``anchor_id``, ``genre``,
    ``emotions``) of those that have some, ``manuscripts`` (``manuscript``, ``title``), ``references`` (``chunk_id``, ``text``).
    Windows of three, and poems, go by poet and volume (poems and poets
    need two records); a manuscript without records is a header alone; an era is fifty years about the middle of two; a
    record adds to every emotion it has; null or blank labels, years and poets make no chunk of their level.  ``seq`` counts
    from 0 over all levels, by level, label, part and id; rows and numbers are dealt by range, no level or group is one task.
    Groups are made and numbered without texts, which are named by their place (``slot``) in a home of ``HOME`` ids.
    """
    home = F.coalesce(F.floor(F.col("anchor_id") / HOME), F.lit(0)).alias("home")
    kept = entries.where(F.trim("text") != "").select(*ENTRY, home, F.xxhash64("text").alias("mark"))
    within = Window.partitionBy("home").orderBy(F.col("anchor_id").asc_nulls_first(), "mark")
    known = kept.withColumn("size", F.octet_length("text")).drop("text").withColumn("slot", F.row_number().over(within) - 1).drop("mark")
    known = known.join(labels.select("anchor_id", *LABELS), "anchor_id", "left").withColumn("emotions", F.coalesce("emotions", F.array().cast("array<string>")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    pair = F.concat(text(F.col("poet")), F.lit("::"), text(F.col("volume")))
    own = {p: F.col(p) for p in PAYLOAD}
    first = {p: F.col(f"first.{p}") for p in PAYLOAD}
    none, blank = F.lit(0).cast("long").alias("part"), F.lit("")
    places = {"slots": F.col("slots"), "home": F.col("home")}
    records = numbered(known, ["poet", "volume"], [F.col("anchor_id").asc()], label="levels-windows")
    out = [records.select(none, *_row("verse", blank, text(F.col("anchor_id")), F.lit(1), blank, F.array("slot"), F.col("home"), **own))]

    runs = neighbours(records, WINDOW, "poet", "volume", *(c for c in PAYLOAD if c != "poet"), "home", "slot")
    head = F.get("run", 0)
    run_pair = F.concat(text(head["poet"]), F.lit("::"), text(head["volume"]))
    near = F.forall("run", lambda x: x["home"] == head["home"])
    slots, far = F.when(near, F.transform("run", lambda x: x["slot"])), F.when(~near, F.transform("run", lambda x: F.struct(x["home"].alias("home"), x["slot"].alias("slot"))))
    out.append(runs.select(none, *_row("group", run_pair, text(head["anchor_id"]), F.lit(WINDOW), blank, slots, head["home"], far, **{p: head[p] for p in PAYLOAD})))

    poems = _parts(records.where("group_rows > 1"), ["poet", "volume"])
    out.append(poems.select("part", *_row("poem", pair, text(F.col("first.anchor_id")), F.col("n"), blank, **places, **first)))

    held = _parts(records, ["manuscript"]).withColumnRenamed("manuscript", "_m")
    all_of = manuscripts.join(held, F.col("manuscript") == F.col("_m"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(all_of.select(F.coalesce("part", F.lit(0)).cast("long").alias("part"), *_row("manuscript", text(F.col("manuscript")), text(F.col("manuscript")), F.col("n"), _headed(F.col("title"), F.col("n")), **places, anchor_id=F.col("first.anchor_id"), manuscript=F.col("manuscript"))))

    poets = _parts(records.where("poet <> ''"), ["poet"], least=2)
    out.append(poets.select("part", *_row("poet", F.col("poet"), F.col("poet"), F.col("n"), _headed(F.col("poet"), F.col("n")), **places, anchor_id=first["anchor_id"], poet=F.col("poet"), manuscript=first["manuscript"])))

    years = _parts(records.withColumn("era", era(F.col("start"), F.col("end"))).where("era IS NOT NULL"), ["era"])
    span = F.concat(F.col("era").cast("string"), F.lit("_"), (F.col("era") + 50).cast("string"))
    out.append(years.select("part", *_row("era", span, span, F.col("n"), _headed(span, F.col("n")), **places, anchor_id=first["anchor_id"])))

    for level, column, rows in (("genre", "genre", records.where("genre <> ''")), ("emotion", "emotion", records.withColumn("emotion", F.explode("emotions")).where("emotion <> ''"))):
        found = _parts(rows, [column, "manuscript"])
        label = F.concat(F.col(column), F.lit("_"), text(F.col("manuscript")))
        carried = {"genre": F.col("genre")} if level == "genre" else {"emotions": F.array("emotion")}
        out.append(found.select("part", *_row(level, label, label, F.col("n"), _headed(F.col(column), F.col("n")), **places, anchor_id=first["anchor_id"], manuscript=F.col("manuscript"), **carried)))

    no_slots, no_home = F.lit(None).cast("array<int>"), F.lit(None).cast("long")
    out.append(references.select(none, *_row("reference", F.col("chunk_id"), F.col("chunk_id"), F.lit(1), F.col("text"), no_slots, no_home)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    order = [F.col("_no").asc(), F.col("_label").asc(), F.col("part").asc_nulls_first(), F.col("anchor_id").asc_nulls_first()]
    placed = numbered(whole, [], order, label="levels")
    chunk_id = F.when(F.col("level") == "reference", F.col("_base")).otherwise(F.concat("_base", F.lit("__"), "level", F.format_string("__%04d", "position")))
    placed = placed.select(F.col("position").alias("seq"), chunk_id.alias("chunk_id"), "level", "part", *PAYLOAD, "n", "_lead", "_home", "_slots", "_far")
    size = records.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    return _texts(placed, kept, tasks).select("seq", "chunk_id", "level", "part", *PAYLOAD, "n", "text")
