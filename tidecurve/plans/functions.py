"""Queries over scalar functions, vectors, pictures, sound and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecurve.functions import labels as L, text as X
from tidecurve.operators import pictures as I, series as S
from tidecurve.plans.base import query
from tidecurve.plans.curves import arrays
from tidecurve.sources.tables import table


@query("sentence_split", f"select doc_id, list_reduce(list_prepend(0, list_transform(s, lambda x: length(x))), lambda a, b: a + b)::bigint as chars, len(s)::int as n, s[1] as first_sentence, s[-1] as last_sentence from (select doc_id, {X.sentences_sql('text')} as s from documents where text is not null) where len(s) > 0")
def sentence_split(spark, d):
    """Sentences of every text, whatever its script."""
    return _sentences(table(spark, d, "documents"))


def _sentences(documents):
    own = documents.where(F.col("text").isNotNull())
    s = S.settled(own.select("doc_id", "text"), s=X.sentences(F.col("text"))).where(F.size("s") > 0)
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + F.length(v))
    return s.select("doc_id", chars.alias("chars"), F.size("s").alias("n"), F.element_at("s", 1).alias("first_sentence"), F.element_at("s", -1).alias("last_sentence"))


_LEX = "(select word, sign(round(sum(sentiment), 6)) as pol from (select sentiment, unnest(string_split(concept, '_')) as word from concepts) group by 1) l"


@query("sentence_polarity", f"select doc_id, count(*) filter (pol > 0) as pos, count(*) filter (pol < 0) as neg from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) t join {_LEX} on t.w = l.word where pol <> 0 group by 1")
def sentence_polarity(spark, d):
    """Positive and negative words of each text by a lexicon: the words of the concepts, with the sign of their summed sentiment."""
    parts = table(spark, d, "concepts").select("sentiment", F.explode(F.split("concept", "_")).alias("w"))
    lexicon = parts.groupBy("w").agg(F.signum(F.round(F.sum("sentiment"), 6)).alias("pol")).where("pol != 0")
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))  # a word once per text before it meets the lexicon
    scored = counted.join(lexicon, "w")
    return scored.groupBy("doc_id").agg(F.sum(F.when(F.col("pol") > 0, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("pol") < 0, F.col("n")).otherwise(0)).alias("neg"))


_SEC = "floor(duration * 17)::bigint"


@query("format_hms", f"select track_id, ({_SEC} // 3600) || 'h' || lpad(({_SEC} % 3600 // 60)::varchar, 2, '0') || 'm' || lpad(({_SEC} % 60)::varchar, 2, '0') || 's' as t from songs")
def format_hms(spark, d):
    return table(spark, d, "songs").select("track_id", X.hms(F.floor(F.col("duration") * 17)).alias("t"))


@query("format_clock", f"select track_id, lpad(({_SEC} // 3600)::varchar, 2, '0') || ':' || lpad(({_SEC} % 3600 // 60)::varchar, 2, '0') || ':' || lpad(({_SEC} % 60)::varchar, 2, '0') as t from songs")
def format_clock(spark, d):
    return table(spark, d, "songs").select("track_id", X.clock(F.floor(F.col("duration") * 17)).alias("t"))


@query("strip_year", "select distinct title, nullif(regexp_extract(title, '^(.+) \\(\\d+\\)?$', 1), '') as name from videopath")
def strip_year(spark, d):
    return table(spark, d, "videopath").select("title", X.strip_year(F.col("title")).alias("name")).distinct()


@query("path_parts", "select file_id, string_split(dirpath, '/')[-1] as base, string_split(dirpath, '/')[1] as root, lower(string_split(file_name, '.')[-1]) as ext from frame_files")
def path_parts(spark, d):
    parts = F.split("dirpath", "/")
    return table(spark, d, "frame_files").select("file_id", F.element_at(parts, -1).alias("base"), F.element_at(parts, 1).alias("root"), F.lower(F.element_at(F.split("file_name", r"\."), -1)).alias("ext"))


@query("last_token", "select rec_id, string_split(id, '_')[-1] as token from tfrecords where id is not null")
def last_token(spark, d):
    return table(spark, d, "tfrecords").where("id is not null").select("rec_id", F.substring_index("id", "_", -1).alias("token"))


_LINE = "concept || ' [sentiment: ' || round(sentiment, 3)::varchar || '] [#imgs: ' || bc || ',000]'"


@query("regex_parse", f"select bc, regexp_extract(line, '^(\\w+) \\[sentiment: ', 1) as name, replace(regexp_extract(line, '\\[#imgs: ([0-9,]+)\\]$', 1), ',', '')::bigint as n from (select bc, {_LINE} as line from concepts)")
def regex_parse(spark, d):
    line = F.concat("concept", F.lit(" [sentiment: "), F.round("sentiment", 3).cast("string"), F.lit("] [#imgs: "), F.col("bc").cast("string"), F.lit(",000]"))
    own = table(spark, d, "concepts").select("bc", line.alias("line"))
    n = F.replace(F.regexp_extract("line", r"\[#imgs: ([0-9,]+)\]$", 1), F.lit(","), F.lit(""))
    return own.select("bc", F.regexp_extract("line", r"^(\w+) \[sentiment: ", 1).alias("name"), n.cast("bigint").alias("n"))


@query("unpivot_map", "unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name feature value v")
def unpivot_map(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "feature", "v")


@query("lexicon_sets", "select word, string_agg(distinct sign, ',' order by sign) as signs from (select unnest(string_split(concept, '_')) as word, case when sentiment < 0 then 'neg' else 'pos' end as sign from concepts) group by 1")
def lexicon_sets(spark, d):
    own = table(spark, d, "concepts").select(F.explode(F.split("concept", "_")).alias("word"), F.when(F.col("sentiment") < 0, "neg").otherwise("pos").alias("sign"))
    return own.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("sign")), ",").alias("signs"))


@query("url_build", "select track_id, 'https://search.example/?q=' || replace(title, ' ', '+') || '+' || replace(artist_name, ' ', '+') as url from songs where title is not null and artist_name is not null")
def url_build(spark, d):
    plus = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("+"))
    return table(spark, d, "songs").where("title is not null and artist_name is not null").select("track_id", F.concat(F.lit("https://search.example/?q="), plus("title"), F.lit("+"), plus("artist_name")).alias("url"))


@query("sent_biclass", "select concept, case when sentiment < 0 then 0 else 1 end as label from concepts where sentiment is not null")
def sent_biclass(spark, d):
    return table(spark, d, "concepts").where("sentiment is not null").select("concept", L.biclass(F.col("sentiment")).alias("label"))


@query("sent_triclass", "select concept, case when sentiment < -0.5 then 0 when sentiment > 0.5 then 2 else 1 end as label from concepts where sentiment is not null")
def sent_triclass(spark, d):
    return table(spark, d, "concepts").where("sentiment is not null").select("concept", L.triclass(F.col("sentiment")).alias("label"))


_NAMES = "['" + "', '".join(L.EMOTIONS) + "']"


@query("label_map", f"select rec_id, {_NAMES}[emo + 1] as emotion, emo::int as label from tfrecords where emo between 0 and 7")
def label_map(spark, d):
    names = F.array(*[F.lit(n) for n in L.EMOTIONS])
    own = table(spark, d, "tfrecords").where("emo between 0 and 7").select("rec_id", F.element_at(names, (F.col("emo") + 1).cast("int")).alias("emotion"))
    return own.withColumn("label", L.label_map(L.EMOTIONS)[F.col("emotion")])


@query("label_unmap", f"select rec_id, {_NAMES}[emo + 1] as emotion from tfrecords where emo between 0 and 7")
def label_unmap(spark, d):
    inverse = F.create_map(*[F.lit(x) for i, n in enumerate(L.EMOTIONS) for x in (i, n)])
    return table(spark, d, "tfrecords").where("emo between 0 and 7").select("rec_id", inverse[F.col("emo").cast("int")].alias("emotion"))


@query("bin_label", "select event_id, case when v < 0 then -1 when v < 5 then 0 when v < 10 then 1 end as label from (select event_id, value / 10 - 1 as v from events)")
def bin_label(spark, d):
    return table(spark, d, "events").select("event_id", L.bin_label(F.col("value") / 10 - 1).alias("label"))


@query("base26_path", "select event_id, chr((65 + event_id // 100 // 676 % 26)::int) || '/' || chr((65 + event_id // 100 // 26 % 26)::int) || '/' || chr((65 + event_id // 100 % 26)::int) as path from events")
def base26_path(spark, d):
    return table(spark, d, "events").select("event_id", X.base26_path(F.col("event_id")).alias("path"))


@query("hex_to_rgb", "select p_partkey, ('0x' || h[1:2])::int as r, ('0x' || h[3:4])::int as g, ('0x' || h[5:6])::int as b from (select p_partkey, lpad(upper(to_hex(p_partkey * 7919 % 16777216)), 6, '0') as h from part)")
def hex_to_rgb(spark, d):
    h = F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return table(spark, d, "part").select("p_partkey", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


# --- vectors -------------------------------------------------------------------------------------------------------
_LONG = "(select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


@query("softmax", f"select vec_id, i::int as i, round(exp(x / 2) / sum(exp(x / 2)) over (partition by vec_id), 8) as p from {_LONG} q")
def softmax(spark, d):
    own = S.settled(_vectors(spark, d), v=L.softmax("v", 2.0))
    return own.select("vec_id", F.posexplode("v").alias("i", "p")).select("vec_id", "i", F.round("p", 8).alias("p"))


@query("argmax_vector", f"select vec_id, arg_max(i, x)::bigint as best from {_LONG} q group by 1")
def argmax_vector(spark, d):
    return _vectors(spark, d).select("vec_id", L.argmax("v").cast("bigint").alias("best"))


@query("standardize_vec", f"with m as (select i, avg(x) as m, stddev_pop(x) as s from {_LONG} q group by 1) select vec_id, q.i::int as i, round((x - m) / s, 5) as z from {_LONG} q join m on q.i = m.i")
def standardize_vec(spark, d):
    long = _vectors(spark, d).select("vec_id", F.posexplode("v").alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(stats), "i").select("vec_id", "i", F.round((F.col("x") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("top10_labels", f"select vec_id, i::int as i, r::int as r from (select *, row_number() over (partition by vec_id order by x desc, i) as r from {_LONG} q) where r <= 10")
def top10_labels(spark, d):
    own = _vectors(spark, d).select("vec_id", F.posexplode(L.top_k("v", 10)).alias("r", "i"))
    return own.select("vec_id", "i", (F.col("r") + 1).alias("r"))


@query("in_top_k", f"select vec_id, max((r <= 5 and i = label)::int) = 1 as top5, max((r <= 10 and i = label)::int) = 1 as top10 from (select *, row_number() over (partition by vec_id order by x desc, i) as r from {_LONG} q) group by 1")
def in_top_k(spark, d):
    return _vectors(spark, d).select("vec_id", F.array_contains(L.top_k("v", 5), F.col("label")).alias("top5"), F.array_contains(L.top_k("v", 10), F.col("label")).alias("top10"))


@query("precision_at_k", f"select label, round(avg((i % 10 = label)::int), 6) as precision from (select *, row_number() over (partition by label order by x desc, vec_id, i) as r from {_LONG} q) where r <= 10 group by 1")
def precision_at_k(spark, d):
    """Share of the ten highest scores of each true label whose class is that label."""
    own = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    # two steps: the ten best of every vector can hold the label's ten best, so the last step sees little
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("x"), "i"))).where("r <= 10")
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "vec_id", "i"))).where("r <= 10")
    return best.groupBy("label").agg(F.round(F.avg((F.col("i") % 10 == F.col("label")).cast("int")), 6).alias("precision"))


@query("loss_rmse", "select round(sqrt(avg((l_discount - l_tax) ** 2)), 8) as loss from lineitem")
def loss_rmse(spark, d):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, d, "lineitem").agg(F.round(F.sqrt(F.avg(e * e)), 8).alias("loss"))


@query("loss_l1", "select round(avg(abs(l_discount - l_tax)), 8) as loss from lineitem")
def loss_l1(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 8).alias("loss"))


@query("loss_huber", "select l_linenumber, round(case when avg(e) < 0.5 then avg(e * e) / 2 else 0.5 * (avg(e) - 0.25) end, 6) as loss from (select l_linenumber, abs(l_discount - l_tax) * 12 as e from lineitem) group by 1")
def loss_huber(spark, d):
    """One switch per batch, by its mean error."""
    own = table(spark, d, "lineitem").select("l_linenumber", (F.abs(F.col("l_discount") - F.col("l_tax")) * 12).alias("e"))
    mean = F.avg("e")
    loss = F.when(mean < 0.5, F.avg(F.col("e") * F.col("e")) / 2).otherwise(0.5 * (mean - 0.25))
    return own.groupBy("l_linenumber").agg(F.round(loss, 6).alias("loss"))


@query("loss_xent", f"select round(avg(-ln(p)), 6) as loss from (select vec_id, i, label, exp(x) / sum(exp(x)) over (partition by vec_id) as p from {_LONG} q) where i = label")
def loss_xent(spark, d):
    own = S.settled(_vectors(spark, d), v=L.softmax("v"))
    return own.agg(F.round(F.avg(-F.ln(F.get("v", F.col("label")))), 6).alias("loss"))


# --- pictures and sound --------------------------------------------------------------------------------------------
@query("crop_geometry", """select rec_id, sw, sh, (sw - 12) // 2 as x, (sh - 12) // 2 as y from (select rec_id, ceil(round(w * s, 6))::bigint as sw, ceil(round(h * s, 6))::bigint as sh from
    (select rec_id, w, h, greatest(12.0::double / w, 12.0::double / h) as s from tfrecords where w > 0 and h > 0))""")
def crop_geometry(spark, d):
    own = table(spark, d, "tfrecords").where("w > 0 and h > 0").select("rec_id", I.crop_geometry(F.col("w"), F.col("h"), 12, 12).alias("g"))
    return own.select("rec_id", "g.*")


@query("palette_hist", "with p as (select * from (values " + ", ".join(f"('{n}', {r}, {g}, {b})" for n, (r, g, b) in I.PALETTE.items()) + """) t(name, r, g, b)),
    c as (select p_partkey, p_partkey * 7919 % 256 as r, p_partkey * 104729 % 256 as g, p_partkey * 1299709 % 256 as b from part)
    select name, count(*) as n from (select c.p_partkey, p.name, row_number() over (partition by c.p_partkey order by (c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2, p.name) as k from c, p) where k = 1 group by 1""")
def palette_hist(spark, d):
    part = lambda m: F.col("p_partkey") * m % 256
    return table(spark, d, "part").groupBy(I.nearest_colour(part(7919), part(104729), part(1299709)).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("scramble_blocks")
def scramble_blocks(spark, d):
    return I.scrambled(table(spark, d, "tfrecords"), "rec_id", I.scramble_blocks, 4).select("rec_id", F.md5("img").alias("digest"))


@query("augment_crops")
def augment_crops(spark, d):
    """Crops of 12 x 12 of the training pictures, at random places, half of them mirrored; by a seed for each row."""
    train = table(spark, d, "tfrecords").where("split = 'train'")
    return I.scrambled(train, "rec_id", lambda a, side, rng: I.augment(a, side, side, rng), 12).select("rec_id", F.octet_length("img").alias("n_bytes"), F.md5("img").alias("digest"))


@query("scramble_recursive")
def scramble_recursive(spark, d):
    return I.scrambled(table(spark, d, "tfrecords"), "rec_id", I.scramble_recursive, 4).select("rec_id", F.md5("img").alias("digest"))


@query("rect_filter", "select l_orderkey, l_linenumber, w, h from (select l_orderkey, l_linenumber, l_quantity as w, l_tax * 500 + 1 as h from lineitem) where w * h > 50 and w * h < 900 and w / h > 1 and w / h < 2.5::double")
def rect_filter(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_tax") * 500 + 1).alias("h"))
    return own.where("w * h > 50 and w * h < 900 and w / h > 1 and w / h < 2.5d")


@query("fit_length", """with s as (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value, count(*) over (partition by user_id) as n from events),
    k as (select distinct series_id, n, k from s, range(64) t(k)) select k.series_id, k.k::int as i, coalesce(s.value, 0) as value from k left join s on s.series_id = k.series_id and s.i = k.k + case when k.n >= 64 then (k.n - 64) // 2 else 0 end""")
def fit_length(spark, d):
    return S.to_long(S.settled(arrays(spark, d), y=I.fit_length("y", 64))).select("series_id", "i", "value")


@query("melgram")
def melgram(spark, d):
    """Frames and mean level of each curve's log mel spectrogram, over the whole curve; a shorter one is repeated to 2048 samples."""

    @F.pandas_udf("struct<frames int, level double>")
    def run(y: pd.Series) -> pd.DataFrame:
        grams = [I.log_melgram(np.resize(np.asarray(v, float), max(2048, len(v)))) for v in y]
        return pd.DataFrame({"frames": [g.shape[1] for g in grams], "level": [round(float(g.mean()), 6) for g in grams]})

    return S.settled(arrays(spark, d), m=run("y")).select("series_id", "m.frames", "m.level")


@query("regex_rgb", "select p_partkey, regexp_extract(s, '^(.*) - R:', 1) as label, regexp_extract(s, 'R:(\\d+) G:(\\d+)', 2)::int as g from (select p_partkey, p_name || ' - R:' || p_size || ' G:' || (p_partkey % 256) || ' B:7' as s from part)")
def regex_rgb(spark, d):
    s = F.concat("p_name", F.lit(" - R:"), F.col("p_size").cast("string"), F.lit(" G:"), (F.col("p_partkey") % 256).cast("string"), F.lit(" B:7"))
    own = table(spark, d, "part").select("p_partkey", s.alias("s"))
    return own.select("p_partkey", F.regexp_extract("s", "^(.*) - R:", 1).alias("label"), F.regexp_extract("s", r"R:(\d+) G:(\d+)", 2).cast("int").alias("g"))


@query("mlp_histogram")
def mlp_histogram(spark, d):
    """A two-layer classifier on 16-bin histograms of the vectors; returns its training confusion counts."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    bins = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter("v", lambda x: F.floor(x * 20 + 8) == k)).cast("double"))
    own = S.settled(_vectors(spark, d), h=bins).select("vec_id", (F.col("label") % 2).cast("double").alias("label"), array_to_vector("h").alias("features"))
    model = MultilayerPerceptronClassifier(layers=[16, 20, 20, 2], maxIter=20, seed=7, blockSize=128).fit(own)
    return model.transform(own).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
