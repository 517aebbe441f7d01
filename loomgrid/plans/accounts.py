"""Accounting, evaluation and run-state queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgrid.operators import account, tasks
from loomgrid.operators.rounds import stored
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import load, membership, unit_links, view

_KIND = "case when status in ('view', 'click') then 'read' when status = 'error' then 'error' else 'write' end"


@query(f"select coalesce({_KIND}, 'all') as kind, count(*) as n, sum(tokens)::bigint as tokens, round(sum(tokens)::double / nullif(sum(case when tokens > 5000 then tokens end), 0), 3) as ratio from task_events group by rollup ({_KIND})", "task_events")
def read_budget(spark, d):
    e = view(spark, d, "task_events").withColumn("k", F.expr(_KIND))
    big = F.sum(F.when(F.col("tokens") > 5000, F.col("tokens")))
    return e.rollup("k").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.try_divide(F.sum("tokens").cast("double"), big), 3).alias("ratio")).select(F.coalesce("k", F.lit("all")).alias("kind"), "n", "tokens", "ratio")


@query("with own as (select task, sum(tokens)::bigint as used from task_events where status = 'purchase' group by 1), other as (select task, sum(tokens)::bigint as used from task_events where status <> 'purchase' group by 1) select task, used, 'state' as basis from own where task % 3 = 0 union all select task, used, 'ledger' from other where task not in (select task from own where task % 3 = 0)", "task_events")
def provider_usage(spark, d):
    """The state's own figures, or the ledger's for tasks that the state has none of."""
    e = view(spark, d, "task_events")
    own = e.filter("status = 'purchase' and task % 3 = 0").groupBy("task").agg(F.sum("tokens").alias("used"))
    other = e.filter("status <> 'purchase'").groupBy("task").agg(F.sum("tokens").alias("used")).join(own, "task", "left_anti")
    return own.withColumn("basis", F.lit("state")).unionByName(other.withColumn("basis", F.lit("ledger")))


@query("select case when size > 25 then 'large' else 'small' end as part, count(*) as n, round(avg(size), 1) as mean, median(size) as median, max(size) as most from units group by 1 union all select 'all', count(*), round(avg(size), 1), median(size), max(size) from units", "units")
def size_stats(spark, d):
    return account.size_stats(view(spark, d, "units"), "size", F.expr("case when size > 25 then 'large' else 'small' end"))


@query("select task, sum(tokens)::bigint as tokens, sum(k)::bigint as k, count(*) as messages from (select task, event_id // 40 as msg, max(tokens) as tokens, max(try_cast(json_extract_string(props, '$.k') as bigint)) as k from task_events group by 1, 2) group by 1", "task_events")
def usage_max_then_sum(spark, d):
    e = view(spark, d, "task_events").select("task", F.expr("event_id div 40").alias("msg"), "tokens", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return account.max_then_sum(e, "msg", "task", ["tokens", "k"])


_PRICE = "case status when 'click' then 1.5e0 when 'view' then 2.5e0 when 'signup' then 4.0e0 when 'purchase' then 8.0e0 end"


@query(f"select task, round(case when count({_PRICE}) = count(*) then sum(tokens * {_PRICE} / 1e6) end, 6) as usd, count(*) - count({_PRICE}) as unpriced from task_events group by task", "task_events")
def cost_null_poison(spark, d):
    e = view(spark, d, "task_events").withColumn("usd", F.col("tokens") * F.expr(_PRICE) / 1e6)
    return e.groupBy("task").agg(F.round(account.sum_if_complete(F.col("usd")), 6).alias("usd"), (F.count("*") - F.count("usd")).alias("unpriced"))


@query("select status, count(*) as n, sum(nullif(tokens % 5, 0))::bigint as known, count(*) filter (where tokens % 5 = 0) as unknown, count(*) filter (where tokens % 5 = 0) = 0 as complete from task_events group by 1", "task_events")
def script_cost(spark, d):
    known = F.when(F.col("tokens") % 5 != 0, F.col("tokens") % 5)
    return view(spark, d, "task_events").groupBy("status").agg(F.count("*").alias("n"), F.sum(known).alias("known"), F.count_if(known.isNull()).alias("unknown"), (F.count_if(known.isNull()) == 0).alias("complete"))


@query("with p(name, price, ordinal) as (values ('red', 1.0e0, 0), ('small', 2.0e0, 1), ('small-ring', 3.0e0, 2), ('green-widget', 4.0e0, 3)), m as (select distinct replace(name, '_', '-') as model from units) select model, name as priced_as, price from (select m.model, p.name, p.price, row_number() over (partition by m.model order by p.ordinal) as n from m left join p on m.model = p.name or starts_with(m.model, p.name || '-')) where n = 1", "units")
def price_prefix_join(spark, d):
    prices = spark.createDataFrame([("red", 1.0, 0), ("small", 2.0, 1), ("small-ring", 3.0, 2), ("green-widget", 4.0, 3)], "name string, price double, ordinal int")
    return account.prices_by_prefix(view(spark, d, "units").select(F.replace("name", F.lit("_"), F.lit("-")).alias("model")).distinct(), prices)


@query("select path, array_to_string(list(kind || ':' || n order by n desc, kind)[1:5], ', ') || case when count(*) > 5 then ' and ' || (count(*) - 5) || ' more' else '' end as listed from (select path, name as kind, count(*) as n from units group by 1, 2) group by path", "units")
def member_files_top5(spark, d):
    counts = view(spark, d, "units").groupBy("path", F.col("name").alias("kind")).agg(F.count("*").alias("n"))
    own = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string")))
    return counts.groupBy("path").agg(own.alias("all")).select("path", F.concat(F.array_join(F.slice("all", 1, 5), ", "), F.when(F.size("all") > 5, F.concat(F.lit(" and "), (F.size("all") - 5).cast("string"), F.lit(" more"))).otherwise("")).alias("listed"))


@query("select count(distinct status) as kinds, array_to_string(list_sort(list(distinct status)), ',') as names, count(distinct task) as tasks from task_events", "task_events")
def models_distinct(spark, d):
    return view(spark, d, "task_events").agg(F.count_distinct("status").alias("kinds"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("names"), F.count_distinct("task").alias("tasks"))


_FILES = "f as (select distinct commit_id, file % 50 as file from commit_files), s as (select commit_id, count(*) as n from f group by 1 having count(*) between 2 and 15)"


@query(f"with {_FILES} select a.file as a, b.file as b, round(sum(1.0e0 / (n - 1)), 6) as weight from f a join s using (commit_id) join f b using (commit_id) where a.file < b.file group by 1, 2", "commit_files")
def cochange_pairs(spark, d):
    return account.cochange(view(spark, d, "commit_files").selectExpr("commit_id", "file % 50 as file"))


@query("select file, \"group\", round(lines / sum(lines) over (partition by file), 6) as share from (select file % 50 as file, commit_id % 6 as \"group\", sum(lines)::bigint as lines from commit_files group by 1, 2)", "commit_files")
def file_membership(spark, d):
    lines = view(spark, d, "commit_files").selectExpr("file % 50 as file", "commit_id % 6 as `group`", "lines").groupBy("file", "group").agg(F.sum("lines").alias("lines"))
    return lines.select("file", "group", F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy("file")), 6).alias("share"))


@query("select \"group\", file, lines, place from (select *, row_number() over (partition by \"group\" order by lines desc, file) as place from (select commit_id % 6 as \"group\", file % 50 as file, sum(lines)::bigint as lines from commit_files group by 1, 2)) where place <= 3", "commit_files")
def view_groups(spark, d):
    from loomgrid.operators.graph import top_per_key

    lines = view(spark, d, "commit_files").selectExpr("file % 50 as file", "commit_id % 6 as `group`", "lines").groupBy("group", "file").agg(F.sum("lines").alias("lines"))
    return top_per_key(lines, "group", [F.desc("lines"), "file"], 3)


@query(
    f"""with {_FILES}, w as (select a.file as a, b.file as b, round(sum(1.0e0 / (n - 1)), 6) as weight from f a join s using (commit_id) join f b using (commit_id) where a.file < b.file group by 1, 2),
    g as (select file as item, "group", lines / sum(lines) over (partition by file) as share from (select file % 50 as file, commit_id % 6 as "group", sum(lines) as lines from commit_files group by 1, 2)),
    k as (select "group", sum(weight * share) as k from (select a as item, weight from w union all select b, weight from w) join g using (item) group by 1)
    select round((select sum(weight * x.share * y.share) from w join g x on x.item = a join g y on y.item = b and y."group" = x."group") / sum(weight) - (select sum(k * k) from k) / (4 * sum(weight) * sum(weight)), 6) as q from w""",
    "commit_files",
)
def soft_modularity(spark, d):
    changes = view(spark, d, "commit_files").selectExpr("commit_id", "file % 50 as file", "commit_id % 6 as `group`", "lines")
    lines = changes.groupBy(F.col("file").alias("item"), "group").agg(F.sum("lines").alias("lines"))
    shares = lines.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy("item")))
    return account.soft_modularity(account.cochange(changes), shares)


@query("select count(*) filter (where n = 0) as empty, sum(greatest(n - 1, 0))::bigint as repeats, count(*) as titles from (select name, count(*) as n from units group by 1)", "units")
def scale_a(spark, d):
    names = view(spark, d, "units").groupBy("name").agg(F.count("*").alias("n"))
    return names.agg(F.count_if(F.col("n") == 0).alias("empty"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeats"), F.count("*").alias("titles"))


@query("select asked, round(sum(case when hit then lines else 0 end) / sum(lines)::double, 6) as recall, round(avg(case when hit then 1.0e0 else 0.0e0 end), 6) as share, round((sum(case when hit then lines else 0 end) / sum(lines)::double) / avg(case when hit then 1.0e0 else 0.0e0 end), 6) as lift from (select commit_id % 20 as asked, file % 3 = 0 as hit, lines from commit_files) group by 1", "commit_files")
def recall_share_lift(spark, d):
    rows = view(spark, d, "commit_files").selectExpr("commit_id % 20 as asked", "file % 3 = 0 as hit", "lines")
    hit = F.sum(F.when(F.col("hit"), F.col("lines")).otherwise(0)) / F.sum("lines").cast("double")
    share = F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))
    return rows.groupBy("asked").agg(F.round(hit, 6).alias("recall"), F.round(share, 6).alias("share"), F.round(hit / share, 6).alias("lift"))


@query("select item % 50 as item, count(*) filter (where quality = 1) as yes, count(*) as votes, count(*) filter (where quality = 1) >= 2 as majority from votes group by 1", "votes")
def majority_vote(spark, d):
    return account.majority(view(spark, d, "votes").selectExpr("item % 50 as item", "quality"), "item", "quality")


@query("select status, median(tokens) as median, quantile_cont(tokens, 0.025) as low, quantile_cont(tokens, 0.975) as high from task_events group by 1", "task_events")
def dimension_median(spark, d):
    return view(spark, d, "task_events").groupBy("status").agg(F.median("tokens").alias("median"), F.percentile("tokens", F.lit(0.025)).alias("low"), F.percentile("tokens", F.lit(0.975)).alias("high"))


@query("select count(*) as n, round(avg((quality = toxic)::int), 6) as agreement, round((avg((quality = toxic)::int) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 6) as kappa from votes", "votes")
def kappa(spark, d):
    return account.kappa(view(spark, d, "votes"), "quality", "toxic")


@query("with leaf as (select node, sum(cents)::double as w, sum(cents * (cents % 100))::double / sum(cents) as s from membership where cents > 0 group by 1), mid as (select parent as node, sum(w) as w, sum(w * s) / sum(w) as s from leaf join nodes on id = node group by 1) select node, round(s, 4) as score from leaf union all select node, round(s, 4) from mid union all select 'root', round(sum(w * s) / sum(w), 4) from mid", "nodes", "membership")
def weighted_tree_score(spark, d):
    """Weighted means from the leaves up: every node by the weights below it."""
    from loomgrid.operators.tree import paths
    from loomgrid.sources.corpus import nodes

    leaf = membership(spark, d).filter("cents > 0").groupBy("node").agg(F.sum("cents").cast("double").alias("w"), (F.sum(F.col("cents") * (F.col("cents") % 100)).cast("double") / F.sum("cents")).alias("s"))
    up = paths(nodes(spark, d)).select(F.col("id").alias("node"), F.explode("path").alias("up"))
    return leaf.join(up, "node").groupBy(F.col("up").alias("node")).agg(F.round(F.sum(F.col("w") * F.col("s")) / F.sum("w"), 4).alias("score"))


@query("select a.task, a.s - b.s as difference from (select task, sum(tokens)::bigint as s from task_events where status = 'view' group by 1) a join (select task, sum(tokens)::bigint as s from task_events where status = 'click' group by 1) b using (task)", "task_events")
def paired_difference(spark, d):
    sums = lambda s: view(spark, d, "task_events").filter(F.col("status") == s).groupBy("task").agg(F.sum("tokens").alias(f"_{s}"))
    return sums("view").join(sums("click"), "task").select("task", (F.col("_view") - F.col("_click")).alias("difference"))


_DRAWN = "('0x' || substr(md5({}), 1, 15))::bigint"


@query(
    f"""with v as (select tokens::double as v, row_number() over (order by tokens) - 1 as place, count(*) over () as n from task_events), n as (select count(*) as n from v),
    p as (select id // n as draw, {_DRAWN.format("'7|' || id")} % n as place from n, range((select n * 200 from n)) t(id)), m as (select draw, avg(v) as mean from p join v using (place) group by draw)
    select (select n from n) as n, round((select avg(v) from v), 4) as mean, round(quantile_cont(mean, 0.025), 4) as low, round(quantile_cont(mean, 0.975), 4) as high from m""",
    "task_events",
)
def bootstrap_ci(spark, d):
    """The mean of all events' tokens, with an interval from 200 resamples."""
    return account.bootstrap(view(spark, d, "task_events").select("tokens"), "tokens", 200)


_LABELS = "select unit, node as \"group\" from membership"
_Q = "coalesce(inside, 0) / m - coalesce(kk, 0) / (4 * m * m)"


@query(
    f"""with pairs as (select least("from", "to") as a, greatest("from", "to") as b, sum(count)::double as weight from unit_links group by 1, 2), l as ({_LABELS}), o as (select unit, "group", row_number() over (order by unit) as place from l),
    r as (select r, unit, "group", row_number() over (partition by r order by {_DRAWN.format("'1|' || r || '|' || unit")}, unit) as place from o, range(30) t(r)),
    s as (select r, o.unit, r."group" from r join o using (place) union all select -1, unit, "group" from l),
    k as (select r, sum(k * k) as kk from (select r, "group", sum(weight) as k from (select a as unit, weight from pairs union all select b, weight from pairs) join s using (unit) group by 1, 2) group by r),
    i as (select x.r, sum(weight) as inside from pairs join s x on x.unit = a join s y on y.unit = b and y.r = x.r and y."group" = x."group" group by x.r), m as (select sum(weight) as m from pairs),
    q as (select r, {_Q} as q from (select distinct r from s) left join k using (r) left join i using (r), m)
    select round((select q from q where r = -1), 6) as q, round((select avg(q) from q where r >= 0), 6) as rand, (select count(distinct "group") from l) as "groups", (select m from m) as edge_weight""",
    "membership", "unit_links",
)
def modularity_b1(spark, d):
    """Modularity of the leaf groups over call weights, and its mean over 30 permutations of the labels."""
    from loomgrid.sources.corpus import membership, unit_meetings

    met = unit_meetings(spark, d)
    pairs = stored(met.groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.count("*").cast("double").alias("weight")))
    labels = membership(spark, d).select(F.col("unit").alias("item"), F.col("node").alias("group"))
    every = stored(account.permuted(labels, "item").unionByName(labels.withColumn("replicate", F.lit(-1).cast("long"))))
    found = account.modularity_of_labels(pairs, every)
    own = found.agg(F.round(F.max(F.when(F.col("replicate") < 0, F.col("q"))), 6).alias("q"), F.round(F.avg(F.when(F.col("replicate") >= 0, F.col("q"))), 6).alias("rand"))
    return own.join(labels.agg(F.count_distinct("group").alias("groups")), F.lit(True)).join(pairs.agg(F.sum("weight").alias("edge_weight")), F.lit(True))


_HELD = "select id as unit, ordinal % 50 as file, 'g' || (ordinal // 3 % 6) as \"group\", size as lines from units"


@query(
    f"""with {_FILES}, pairs as (select a.file as a, b.file as b, round(sum(1.0e0 / (n - 1)), 6) as weight from f a join s using (commit_id) join f b using (commit_id) where a.file < b.file group by 1, 2),
    held as ({_HELD}), o as (select *, row_number() over (order by unit) as place from held),
    r as (select r, "group", row_number() over (partition by r order by {_DRAWN.format("'1|' || r || '|' || unit")}, unit) as place from o, range(30) t(r)),
    units_r as (select r, o.file, r."group", o.lines from r join o using (place) union all select -1, file, "group", lines from held),
    shares as (select r, file, "group", sum(lines) / sum(sum(lines)) over (partition by r, file)::double as share from units_r group by 1, 2, 3),
    best as (select file, "group", row_number() over (order by file) as place from (select file, "group", row_number() over (partition by file order by sum(lines) desc, "group") as n from held group by file, "group") where n = 1),
    rf as (select r, "group", row_number() over (partition by r order by {_DRAWN.format("'2|' || r || '|' || file")}, file) as place from best, range(30) t(r)),
    every as (select r, file as item, "group", share from shares union all select 100 + r, best.file, rf."group", 1.0 from rf join best using (place)),
    k as (select r, sum(k * k) as kk from (select r, "group", sum(weight * share) as k from (select a as item, weight from pairs union all select b, weight from pairs) join every using (item) group by 1, 2) group by r),
    i as (select x.r, sum(weight * x.share * y.share) as inside from pairs join every x on x.item = a join every y on y.item = b and y.r = x.r and y."group" = x."group" group by x.r), m as (select sum(weight) as m from pairs),
    q as (select r, {_Q} as q from (select distinct r from every) left join k using (r) left join i using (r), m)
    select round((select q from q where r = -1), 6) as q, round((select avg(q) from q where r between 0 and 99), 6) as rand_unit, round((select avg(q) from q where r >= 100), 6) as rand_file, (select count(distinct "group") from held) as "groups", round((select m from m), 3) as pair_weight""",
    "commit_files", "units",
)
def modularity_b2(spark, d):
    """Modularity of files that change together, by their units' labels, and its means over permutations of units' and of files' labels."""
    pairs = account.cochange(view(spark, d, "commit_files").selectExpr("commit_id", "file % 50 as file"))
    held = view(spark, d, "units").selectExpr("id as item", "ordinal % 50 as file", "'g' || (ordinal div 3 % 6) as `group`", "size as lines")
    dealt = account.permuted(held.select("item", "group"), "item").join(held.select("item", "file", "lines"), "item")
    every = account.file_shares(dealt.unionByName(held.withColumn("replicate", F.lit(-1).cast("long"))), ["replicate"])
    lines = held.groupBy("file", "group").agg(F.sum("lines").alias("n"))
    # of groups with equal lines the first name
    best = lines.groupBy("file").agg(F.max("n").alias("_most")).join(lines, "file").filter("n = _most").groupBy(F.col("file").alias("item")).agg(F.min("group").alias("group"))
    files = account.hard(account.permuted(best, "item", seed=2)).withColumn("replicate", F.col("replicate") + 100)
    found = account.modularity_of_replicates(pairs, every.unionByName(files.select(*every.columns)))
    r, mean = F.col("replicate"), lambda w: F.round(F.avg(F.when(w, F.col("q"))), 6)
    own = found.agg(mean(r < 0).alias("q"), mean(r.between(0, 99)).alias("rand_unit"), mean(r >= 100).alias("rand_file"))
    return own.join(held.agg(F.count_distinct("group").alias("groups")), F.lit(True)).join(pairs.agg(F.round(F.sum("weight"), 3).alias("pair_weight")), F.lit(True))


@query("select id, path, size, kept from (select id, path, size, size % 2 = 1 as kept from units where ordinal % 5 <> 0 union all select id, path, size, false from units where ordinal % 5 = 0)", "units")
def replay_filter(spark, d):
    """Units that an earlier run covers, and the rest marked as index only."""
    units = view(spark, d, "units")
    old = units.filter("ordinal % 5 <> 0").select("id", (F.col("size") % 2 == 1).alias("_kept"))
    return units.join(old, "id", "left").select("id", "path", "size", F.coalesce("_kept", F.lit(False)).alias("kept"))


@query("select coalesce(language, 'all') as language, case when grouping(big) = 1 then 'all' when big then 'big' else 'small' end as part, count(*) as files, sum(lines)::bigint as lines, sum(bytes)::bigint as bytes from (select language, strlen(source) > 2000 as big, len(string_split(source, chr(10))) as lines, strlen(source) as bytes from files) group by grouping sets ((language, big), (language), ())", "files")
def corpus_sizes(spark, d):
    rows = view(spark, d, "files").select("language", (F.octet_length("source") > 2000).alias("big"), F.size(F.split("source", "\n")).alias("lines"), F.octet_length("source").alias("bytes"))
    sets = rows.groupingSets([["language", "big"], ["language"], []], "language", "big").agg(F.grouping("big").alias("g"), F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    return sets.select(F.coalesce("language", F.lit("all")).alias("language"), F.when(F.col("g") == 1, "all").when(F.col("big"), "big").otherwise("small").alias("part"), "files", "lines", "bytes")


@query("select count(*) as requests, count(*) filter (where status = 'error') as rejected, round(count(*) filter (where status = 'error') / count(*)::double, 6) as ratio, count(distinct task) as tasks, (select count(*) from (select task from task_events group by 1 having count(*) filter (where status = 'purchase') = 0)) as idle from task_events", "task_events")
def run_readings(spark, d):
    by = view(spark, d, "task_events").groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("e"), F.count_if(F.col("status") == "purchase").alias("p"))
    return by.agg(F.sum("n").alias("requests"), F.sum("e").alias("rejected"), F.round(F.sum("e") / F.sum("n"), 6).alias("ratio"), F.count("*").alias("tasks"), F.count_if(F.col("p") == 0).alias("idle"))


@query("select subset, status, round(avg(tokens), 4) as mean from (select status, tokens, unnest(['all', 'task' || task % 3]) as subset from task_events) group by 1, 2", "task_events")
def subgroup_means(spark, d):
    subset = F.explode(F.array(F.lit("all"), F.concat(F.lit("task"), (F.col("task") % 3).cast("string")))).alias("subset")
    return view(spark, d, "task_events").select("status", "tokens", subset).groupBy("subset", "status").agg(F.round(F.avg("tokens"), 4).alias("mean"))


_LAST = "l as (select task, status, ts, event_id, tokens from (select *, row_number() over (partition by task order by ts desc, event_id desc) as n from task_events) where n = 1), t as (select task, case when task < 5 then null else task // 5 end as parent, case status when 'purchase' then 'done' when 'error' then 'failed' when 'click' then 'leased' else 'pending' end as state from l)"


def _tasks(spark, d):
    last = tasks.last_state(view(spark, d, "task_events"))
    return last.selectExpr("task", "case when task < 5 then null else task div 5 end as parent", "case status when 'purchase' then 'done' when 'error' then 'failed' when 'click' then 'leased' else 'pending' end as state")


@query(f"with {_LAST} select task, status, event_id from l", "task_events")
def last_state(spark, d):
    return tasks.last_state(view(spark, d, "task_events")).select("task", "status", "event_id")


@query(f"with {_LAST} select task, parent, state from t where state = 'pending' and (parent is null or parent in (select task from t where state = 'done'))", "task_events")
def ready_tasks(spark, d):
    return tasks.ready(_tasks(spark, d))


@query(f"with {_LAST} select task, parent, state from t where state = 'pending' and parent in (select task from t where state = 'failed')", "task_events")
def blocked_tasks(spark, d):
    return tasks.blocked(_tasks(spark, d))


@query(f"with {_LAST} select task, kind, rank from (select task, 'k' || task % 4 as kind, case task % 4 when 2 then 0 when 0 then 1 when 1 then 2 else 3 end as rank from t) order by rank, task limit 12", "task_events")
def dispatch_order(spark, d):
    waiting = _tasks(spark, d).selectExpr("task", "'k' || task % 4 as kind")
    return tasks.dispatched(waiting, {"k2": 0, "k0": 1, "k1": 2}, 12)


@query(f"with {_LAST} select task, epoch(timestamp '2024-01-31')::bigint - epoch(date_trunc('second', ts))::bigint as age from l where status in ('click', 'view') and epoch(timestamp '2024-01-31') - epoch(date_trunc('second', ts)) > 3600", "task_events")
def lease_reclaim(spark, d):
    leases = tasks.last_state(view(spark, d, "task_events")).filter("status in ('click', 'view')")
    return tasks.reclaimed(leases, F.lit("2024-01-31").cast("timestamp"), 3600).select("task", "age")


@query("select task, count(*) % 3 as attempt, count(*) >= 70 as final from task_events where status <> 'view' group by 1", "task_events")
def attempt_limits(spark, d):
    return view(spark, d, "task_events").filter("status <> 'view'").groupBy("task").agg((F.count("*") % 3).alias("attempt"), (F.count("*") >= 70).alias("final"))


@query("select id, case when r.size is not null then 'fixed ' || u.name else u.name end as name, coalesce(r.size, u.size) as size, r.size is not null as repaired from units u left join (select id, size + 1 as size from units where ordinal % 9 = 0) r using (id)", "units")
def unit_merge_supersede(spark, d):
    units = view(spark, d, "units").select("id", "name", "size")
    return tasks.superseded(units, view(spark, d, "units").filter("ordinal % 9 = 0").selectExpr("id", "'fixed ' || name as name", "size + 1 as size"), "id")


@query("select distinct path from units where path not in (select path from units where size > 30)", "units")
def empty_batches(spark, d):
    units = view(spark, d, "units")
    return units.select("path").distinct().join(units.filter("size > 30").select("path"), "path", "left_anti")


@query("select path, array_to_string(list(name order by ordinal), '|') as source, sum(size)::bigint as tokens, case when count(distinct kind) = 1 then min(kind) else '' end as language from units group by path", "units")
def unit_source_caps(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    return view(spark, d, "units").groupBy("path").agg(F.array_join(names, "|").alias("source"), F.sum("size").alias("tokens"), F.when(F.count_distinct("kind") == 1, F.min("kind")).otherwise("").alias("language"))


@query("select task, sum(tokens)::bigint as spent, sum(tokens) > 1.5 * 900000 and 900000 >= 20000 as stop from task_events group by 1", "task_events")
def budget_gate(spark, d):
    return view(spark, d, "task_events").groupBy("task").agg(F.sum("tokens").alias("spent"), (F.sum("tokens") > 1.5 * 900000).alias("stop"))


@query("select flag, count(*) as n from (select unnest(string_split(props, ':')) as flag from task_events) where flag like ' %' or flag like '{%' group by 1", "task_events")
def flag_counts(spark, d):
    flags = view(spark, d, "task_events").select(F.explode(F.split("props", ":")).alias("flag"))
    return flags.filter(F.col("flag").startswith(" ") | F.col("flag").startswith("{")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"with {_LAST} select count(*) filter (where state in ('done', 'failed')) as reviewed, count(*) filter (where state = 'pending') as waiting, max_by(task, (select count(*) from task_events e where e.task = t.task) * 1000 - task) as largest from t", "task_events")
def review_summary(spark, d):
    e = view(spark, d, "task_events").groupBy("task").agg(F.count("*").alias("n"))
    return _tasks(spark, d).join(e, "task").agg(F.count_if(F.col("state").isin("done", "failed")).alias("reviewed"), F.count_if(F.col("state") == "pending").alias("waiting"), F.max_by("task", F.col("n") * 1000 - F.col("task")).alias("largest"))


@query("select kind, count(*) as \"groups\", array_to_string(list_sort(list(n)), ',') as sizes from (select kind, path, count(*) as n from units group by 1, 2) where n > 1 group by 1", "units")
def layer_shape(spark, d):
    by = view(spark, d, "units").groupBy("kind", "path").agg(F.count("*").alias("n")).filter("n > 1")
    return by.groupBy("kind").agg(F.count("*").alias("groups"), F.array_join(F.sort_array(F.collect_list("n")), ",").alias("sizes"))


@query("select event_id, tokens, 2000 as embedded from task_events where tokens < 0.5 * 2000", "task_events")
def delivery_floor(spark, d):
    return view(spark, d, "task_events").filter("tokens < 0.5 * 2000").select("event_id", "tokens", F.lit(2000).alias("embedded"))


@query(f"with {_LAST} select state, count(*) as n, case when state = 'failed' then 'retry' when state = 'pending' then 'dispatch' else 'wait' end as next_action from t group by 1", "task_events")
def status_counts(spark, d):
    return _tasks(spark, d).groupBy("state").agg(F.count("*").alias("n")).withColumn("next_action", F.when(F.col("state") == "failed", "retry").when(F.col("state") == "pending", "dispatch").otherwise("wait"))


@query("select count(*) as compared, count(*) filter (where a.h is distinct from b.h) as differing from (select id, md5(coalesce(source, '') || coalesce(target, '')) as h from edges where kind = 'call') a full join (select id, md5(coalesce(source, '') || case when weight = 50 then 'x' else coalesce(target, '') end) as h from edges where kind = 'call') b using (id)", "edges")
def graph_equal_modulo_kind(spark, d):
    """Two graphs without one kind of edge, compared edge by edge."""
    edges = view(spark, d, "edges").filter("kind = 'call'")
    a = edges.selectExpr("id", "md5(coalesce(source, '') || coalesce(target, '')) as ha")
    b = edges.selectExpr("id", "md5(coalesce(source, '') || case when weight = 50 then 'x' else coalesce(target, '') end) as hb")
    return a.join(b, "id", "full_outer").agg(F.count("*").alias("compared"), F.count_if(~F.col("ha").eqNullSafe(F.col("hb"))).alias("differing"))


@query("select count(*) filter (where digest = md5(source)) = count(*) as digests_agree, count(distinct path) = count(*) as paths_unique, count(*) as files from files", "files")
def plan_agreement(spark, d):
    return view(spark, d, "files").agg((F.count_if(F.col("digest") == F.md5("source")) == F.count("*")).alias("digests_agree"), (F.count_distinct("path") == F.count("*")).alias("paths_unique"), F.count("*").alias("files"))


@query("select task, count(*) as n from (select try_cast(regexp_extract('task-' || task || ' (' || status || ')', 'task-([0-9]+)', 1) as bigint) as task, ts from task_events) where ts >= timestamp '2024-01-15' group by 1", "task_events")
def usage_label_join(spark, d):
    label = F.concat(F.lit("task-"), F.col("task").cast("string"), F.lit(" ("), "status", F.lit(")"))
    rows = view(spark, d, "task_events").select(F.regexp_extract(label, "task-([0-9]+)", 1).cast("long").alias("task"), "ts")
    return rows.filter(F.col("ts") >= F.expr("timestamp_ntz '2024-01-15'")).groupBy("task").agg(F.count("*").alias("n"))


@query("select path, id, case when n % 12 = 1 and n > 1 and i = n - 1 then (n - 2) // 12 else i // 12 end as \"group\" from (select path, id, row_number() over (partition by kind order by ordinal) - 1 as i, count(*) over (partition by kind) as n from units)", "units")
def pack_groups(spark, d):
    return tasks.packed(view(spark, d, "units"), "kind", ["ordinal"], 12).select("path", "id", "group")
