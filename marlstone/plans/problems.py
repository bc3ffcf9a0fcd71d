"""Queries of the general data problems, over whole tables, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import eav, nested, quality, skew
from marlstone.sources.tables import table


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    columns = eav.wanted(table(spark, d, "detail_columns"))
    return eav.wide_table(eav.detail_rows(table(spark, d, "meta_items")), columns).withColumnRenamed("entity", "row_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    columns = eav.wanted(table(spark, d, "detail_columns"))
    wide = eav.wide_table(eav.detail_rows(table(spark, d, "meta_items")), columns)
    return eav.cells(wide, columns).withColumnRenamed("entity", "row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_tables(table(spark, d, "meta_items"))


def p4_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many elements and rows each structural variant holds."""
    routed = nested.route_elements(table(spark, d, "meta_items"), "row_id", "images")
    return routed.groupBy("kind").agg(F.count(F.lit(1)).alias("elements"), F.count_distinct("row_id").alias("listings"))


def p4_flat(spark: SparkSession, d: str) -> DataFrame:
    """The typed table of the commonest variant, a column per rendition."""
    return nested.variant_table(nested.route_elements(table(spark, d, "meta_items"), "row_id", "images"), "flat")


def p4_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Elements of no known shape, as they are."""
    return nested.variant_table(nested.route_elements(table(spark, d, "meta_items"), "row_id", "images"), "none")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.top_votes(table(spark, d, "reviews")).select("parent_asin", "load_no", "review_id")


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    """Per product key the span of its review ids and the largest step between neighbours, an ordered fold."""
    reviews = table(spark, d, "reviews")
    slim = reviews.select(skew.product_key(F.col("parent_asin")).alias("key"), "review_id").where("key is not null")
    return skew.chunk_runs(slim, ["key"], "review_id")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.profile(quality.catalogue_values(table(spark, d, "meta_items"), table(spark, d, "reviews")))


def p6_measures(spark: SparkSession, d: str) -> DataFrame:
    """The standard aggregates of the profile, by column and load."""
    rounded = [F.round(c, 9).alias(c) for c in ("missing", "invalid", "dominant", "shift")]
    return p6_profile(spark, d).select("table_name", "column_name", "load_no", "n_rows", "distinct_values", *rounded)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(p6_profile(spark, d))


def p6_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Expressions of prices and votes with the rows they cover."""
    values = quality.catalogue_values(table(spark, d, "meta_items"), table(spark, d, "reviews")).where("state != 'missing'").withColumn("bad", F.col("state") == "invalid")
    return quality.induce(values).groupBy("column_name", "level", "expression").agg(F.sum("n").alias("n_rows"))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p4_found": p4_found, "p4_variants": p4_variants, "p4_flat": p4_flat, "p4_unknown": p4_unknown, "p5_found": p5_found, "p5_steps": p5_steps, "p6_found": p6_found, "p6_profile": p6_profile, "p6_measures": p6_measures, "p6_expressions": p6_expressions}

# what the columns mean and the units are worth, written out once more, so that the SQL does not follow the operator's own tables
_SPELLINGS = """('weight', 'weight_g'), ('item weight', 'weight_g'), ('product weight', 'weight_g'), ('net weight', 'weight_g'), ('gewicht', 'weight_g'), ('poids', 'weight_g'), ('peso', 'weight_g'),
    ('length', 'length_mm'), ('item length', 'length_mm'), ('product length', 'length_mm'), ('länge', 'length_mm'), ('longueur', 'length_mm'), ('longitud', 'length_mm'),
    ('power', 'power_w'), ('wattage', 'power_w'), ('power consumption', 'power_w'), ('leistung', 'power_w'), ('puissance', 'power_w'), ('potencia', 'power_w'),
    ('warranty', 'warranty_months'), ('warranty period', 'warranty_months'), ('manufacturer warranty', 'warranty_months'), ('garantie', 'warranty_months'), ('garantía', 'warranty_months'),
    ('pieces', 'piece_count'), ('piece count', 'piece_count'), ('number of pieces', 'piece_count'), ('anzahl teile', 'piece_count'),
    ('release date', 'released_on'), ('released on', 'released_on'), ('date first available', 'released_on'), ('first available on', 'released_on'), ('available since', 'released_on'),
    ('waterproof', 'waterproof'), ('is waterproof', 'waterproof'), ('wasserdicht', 'waterproof'), ('color', 'color'), ('colour', 'color'), ('farbe', 'color'), ('couleur', 'color'),
    ('material', 'material'), ('material type', 'material'), ('matériau', 'material')"""
_UNITS = """('weight_g', 'g', 1), ('weight_g', 'gr', 1), ('weight_g', 'gram', 1), ('weight_g', 'grams', 1), ('weight_g', 'kg', 1000), ('weight_g', 'lb', 453.59237), ('weight_g', 'lbs', 453.59237),
    ('weight_g', 'pound', 453.59237), ('weight_g', 'pounds', 453.59237), ('weight_g', 'oz', 28.349523125), ('weight_g', 'ounce', 28.349523125), ('weight_g', 'ounces', 28.349523125),
    ('length_mm', 'mm', 1), ('length_mm', 'millimeters', 1), ('length_mm', 'millimetres', 1), ('length_mm', 'centimeters', 10), ('length_mm', 'centimetres', 10), ('length_mm', 'centimeter', 10), ('length_mm', 'meters', 1000), ('length_mm', 'metres', 1000), ('length_mm', 'meter', 1000), ('length_mm', 'foot', 304.8),
    ('weight_g', 'kgs', 1000), ('weight_g', 'kilograms', 1000), ('weight_g', 'kilogram', 1000), ('weight_g', 'gramm', 1), ('weight_g', 'kilo', 1000), ('weight_g', 'mg', 0.001), ('power_w', 'kilowatts', 1000), ('warranty_months', 'mos', 1), ('warranty_months', 'monat', 1), ('warranty_months', 'jahr', 12), ('piece_count', 'ct', 1), ('piece_count', 'set', 1), ('length_mm', 'cm', 10), ('length_mm', 'm', 1000), ('length_mm', 'in', 25.4), ('length_mm', 'inch', 25.4), ('length_mm', 'inches', 25.4), ('length_mm', '"', 25.4),
    ('length_mm', 'ft', 304.8), ('length_mm', 'feet', 304.8), ('power_w', 'w', 1), ('power_w', 'watt', 1), ('power_w', 'watts', 1), ('power_w', 'kw', 1000), ('power_w', 'kilowatt', 1000),
    ('warranty_months', 'mo', 1), ('warranty_months', 'mths', 1), ('warranty_months', 'month', 1), ('warranty_months', 'months', 1), ('warranty_months', 'monate', 1), ('warranty_months', 'y', 12),
    ('warranty_months', 'yr', 12), ('warranty_months', 'yrs', 12), ('warranty_months', 'year', 12), ('warranty_months', 'years', 12), ('warranty_months', 'jahre', 12),
    ('piece_count', '', 1), ('piece_count', 'pc', 1), ('piece_count', 'pcs', 1), ('piece_count', 'piece', 1), ('piece_count', 'pieces', 1), ('piece_count', 'pack', 1), ('piece_count', 'count', 1), ('piece_count', 'teile', 1)"""
_NOTHING = "'', '-', '--', '?', 'n/a', 'n.a.', 'na', 'none', 'null', 'nan', 'tbd', 'tba', 'unknown', 'various', 'see description', 'not specified', 'not applicable'"

ORACLE = {
    "p1_found": rf"""
        with t as (select row_id, case when json_valid(details) then case json_type(details) when 'VARCHAR' then details::json ->> '$' else details end end as d from meta_items),
        j as (select row_id, d::json as j from t where json_valid(d)),
        a as (select row_id, k, json_extract(j, '$."' || k || '"') as v from (select row_id, j, unnest(json_keys(j)) as k from j where json_type(j) = 'OBJECT')
              union all select row_id, coalesce(r ->> '$.name', r ->> '$.attribute', r ->> '$.k'), coalesce(json_extract(r, '$.value'), json_extract(r, '$.val'), json_extract(r, '$.v'))
              from (select row_id, unnest(json_extract(j, '$[*]')) as r from j where json_type(j) = 'ARRAY')),
        o as (select row_id, k, v from a where json_type(v) <> 'OBJECT' or json_extract(v, '$.value') is not null
              union all select row_id, k, json_extract(v, '$."' || k || '"') from (select row_id, v, unnest(json_keys(v)) as k from a where json_type(v) = 'OBJECT' and json_extract(v, '$.value') is null)),
        n(name, col) as (values {_SPELLINGS}), w(col, unit, worth) as (values {_UNITS}),
        s as (select row_id, n.col, d.value_type as kind, lower(trim(case when json_type(v) = 'OBJECT' then (v ->> '$.value') || ' ' || (v ->> '$.unit') else v ->> '$' end)) as x
              from o join n on n.name = trim(regexp_replace(lower(regexp_replace(k, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) join detail_columns d on d.column_name = n.col),
        p as (select *, regexp_extract(x, '\d+(?:[.,]\d+)*', 0) as num, regexp_extract(x, '\d+(?:[.,]\d+)*[\s\-]*([\p{{L}}"]*)', 1) as unit from s where x not in ({_NOTHING})),
        c as (select row_id, p.col, case kind
              when 'int' then cast(round(try_cast(replace(regexp_replace(num, ',(\d{{3}})\b', '\1', 'g'), ',', '.') as double) * w.worth) as bigint)::varchar
              when 'date' then try_strptime(x, ['%Y-%m-%d', '%Y/%m/%d', '%d.%m.%Y', '%Y%m%d', '%d %B %Y', '%B %d, %Y', '%d %b %Y', '%b %d, %Y'])::date::varchar
              when 'bool' then case when x in ('yes', 'y', 'true') then 'true' when x in ('no', 'n', 'false', 'not waterproof') then 'false' end else x end as cell
              from p left join w on w.col = p.col and w.unit = p.unit)
        select distinct row_id, col as column_name, cell from c where cell is not null""",
    "p5_found": r"""
        with r as (select upper(regexp_replace(parent_asin, '[^\p{L}\p{Nd}]', '', 'g')) k, load_no, review_id, helpful_vote v from reviews),
        g as (select *, count(*) over (partition by k, load_no) n from r where length(k) = 10),
        f as (select *, row_number() over (partition by k, load_no order by v desc, review_id) i
              from g where n >= 10 and v between 0 and 1000000)
        select k as parent_asin, cast(load_no as bigint) as load_no, review_id from f where i = 1""",
    "p5_steps": r"""
        with r as (select upper(regexp_replace(parent_asin, '[^\p{L}\p{Nd}]', '', 'g')) as key, review_id from reviews where parent_asin is not null),
        s as (select *, review_id - lag(review_id) over (partition by key order by review_id) as step from r)
        select key, count(*) as n_rows, min(review_id) as first, max(review_id) as last, max(step) as largest_step from s group by key""",
    "p4_found": r"""
        with e as (select row_id, unnest(images) as e, unnest(range(len(images))) as pos from meta_items),
        f as (select row_id, pos, case when json_valid(e) then case json_type(e) when 'VARCHAR' then e::json ->> '$' when 'OBJECT' then e end end as t from e),
        j as (select row_id, pos, t::json as j from f where json_valid(t) and json_type(t) = 'OBJECT'),
        l as (select unnest(['thumb', 'large', 'hi_res']) as label),
        a as (select row_id, pos, j, label, j ->> ('$.' || label) as url from j, l
              union all select row_id, pos, j, label, j ->> ('$.media.sizes.' || label || '.url') from j, l
              union all select row_id, pos, j, label, unnest(case label when 'thumb' then json_extract_string(j, '$.sets[*].files[*].thumb')
                when 'large' then json_extract_string(j, '$.sets[*].files[*].large') else json_extract_string(j, '$.sets[*].files[*].hi_res') end) from j, l
              union all select row_id, pos, j, r ->> '$.type', r ->> '$.url' from (select row_id, pos, j, unnest(json_extract(j, '$.renditions[*]')) as r from j)),
        i as (select distinct row_id, pos, label, coalesce(j ->> '$.variant', j ->> '$.meta.variant', '') as parent from a where trim(url) <> '' and label in ('thumb', 'large', 'hi_res')),
        c as (select row_id, unnest(categories) as x, unnest(range(len(categories))) as n from meta_items),
        s as (select row_id, n, case when trim(x) like '[%' and json_valid(x) then from_json(x, '["VARCHAR"]') else regexp_split_to_array(x, '[>|]|\s/\s') end as xs from c where x is not null),
        k as (select row_id, n, unnest(xs) as x, unnest(range(len(xs))) as m from s),
        d as (select row_id, n, m, trim(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), E' \t\n\r') as label from k),
        p as (select row_id, row_number() over w - 1 as pos, label, coalesce(lag(label) over w, '') as parent from d where label <> '' window w as (partition by row_id order by n, m))
        select row_id, 'images' as field, pos, label, parent from i union all select row_id, 'categories', pos, label, parent from p""",
    "p6_found": r"""
        with u as (
            select 'meta_items' as t, 'description' as c, load_no as l, to_json(description)::varchar as v, list_sum(list_transform(description, lambda x: coalesce(length(x), 0)))::double as x,
                coalesce(len(list_filter(description, lambda x: x is not null and regexp_replace(x, '\s', '', 'g') <> '')) = 0, true) as m,
                len(list_filter(description, lambda x: x is not null and regexp_matches(x, '[A-Za-z]{3}'))) = 0 as bad from meta_items
            union all select 'meta_items', 'price', load_no, price::varchar, price, price is null, isnan(price) or not (price > 0 and price < 100000) from meta_items
            union all select 'reviews', 'helpful_vote', load_no, helpful_vote::varchar, helpful_vote, helpful_vote is null, not (helpful_vote between 0 and 1000000) from reviews),
        n as (select t, c, l, count(*)::double as n, count(*) filter (m)::double as m, count(*) filter (not m and bad)::double as b, nullif(count(*) filter (not m and not bad), 0)::double as g from u group by all),
        d as (select t, c, l, max(k)::double as top from (select t, c, l, v, count(*) as k from u where not m and not bad group by all) group by all),
        s as (select n.t, n.c, n.l, m / n.n as miss, b / nullif(n.n - m, 0) as inv, top / g as dom, g from n left join d using (t, c, l)),
        z as (select * from s where l = 0),
        w as (select s.t, s.c, s.l, u.x, sum(case when u.l = s.l then 1 / s.g else -1 / z.g end) as w
              from s join z using (t, c) join u on u.t = s.t and u.c = s.c and (u.l = s.l or u.l = 0) where s.l > 0 and s.g > 0 and z.g > 0 and not u.m and not u.bad group by all),
        r as (select t, c, l, abs(sum(w) over (partition by t, c, l order by x)) as r from w),
        q as (select t, c, l, max(r) as shift from r group by all),
        a as (select s.*, z.miss as miss0, z.inv as inv0, z.dom as dom0, q.shift from s join z using (t, c) left join q on q.t = s.t and q.c = s.c and q.l = s.l where s.l > 0),
        i as (select *, unnest(['missing', 'invalid', 'dominant', 'shift']) as issue, unnest([miss - miss0 > 0.15, inv - inv0 > 0.05, dom - dom0 > 0.2, shift > 0.3]) as holds from a)
        select t as table_name, c as column_name, cast(l as bigint) as load_no, issue from i where holds""",
}
_CELLS = ORACLE["p1_found"]
ORACLE["p1_wide"] = f"""
        with f as ({_CELLS}), p as (select row_id, {", ".join(f"max(cell) filter (column_name = '{c}') as {c}" for c in ("weight_g", "length_mm", "power_w", "warranty_months", "piece_count", "released_on", "waterproof", "color", "material"))} from f group by 1)
        select m.row_id, {", ".join(f"cast(p.{c} as {t}) as {c}" for c, t in (("weight_g", "bigint"), ("length_mm", "bigint"), ("power_w", "bigint"), ("warranty_months", "bigint"), ("piece_count", "bigint"), ("released_on", "date"), ("waterproof", "boolean"), ("color", "varchar"), ("material", "varchar")))}
        from meta_items m left join p on p.row_id = m.row_id"""
_KINDS = """
        with e as (select row_id, unnest(images) as e, unnest(range(len(images))) as pos from meta_items),
        f as (select row_id, pos, e, case when json_valid(e) then case json_type(e) when 'VARCHAR' then e::json ->> '$' when 'OBJECT' then e end end as t from e),
        k as (select row_id, pos, e, t, case when not json_valid(t) or json_type(t) <> 'OBJECT' then 'none' when json_exists(t, '$.renditions') then 'listed' when json_exists(t, '$.media') then 'sized'
              when json_exists(t, '$.sets') then 'grouped' when json_exists(t, '$.thumb') or json_exists(t, '$.large') or json_exists(t, '$.hi_res') then 'flat' else 'none' end as kind from f)"""
ORACLE["p4_variants"] = _KINDS + " select coalesce(kind, 'none') as kind, count(*) as elements, count(distinct row_id) as listings from k group by 1"
ORACLE["p4_flat"] = _KINDS + " select row_id, pos, t ->> '$.variant' as variant, t ->> '$.thumb' as thumb, t ->> '$.large' as large, t ->> '$.hi_res' as hi_res from k where kind = 'flat'"
ORACLE["p4_unknown"] = _KINDS + " select row_id, pos, e as raw from k where coalesce(kind, 'none') = 'none'"
_MEASURES = ORACLE["p6_found"].partition("a as (select s.*")[0].rstrip().rstrip(",")
ORACLE["p6_measures"] = f"""{_MEASURES},
        v as (select t, c, l, count(distinct (v, x)) as k from u where not m group by all)
        select s.t as table_name, s.c as column_name, cast(s.l as bigint) as load_no, cast(n.n as bigint) as n_rows, coalesce(v.k, 0) as distinct_values,
            round(s.miss, 9) as missing, round(s.inv, 9) as invalid, round(s.dom, 9) as dominant, round(q.shift, 9) as shift
        from s join n using (t, c, l) left join q using (t, c, l) left join v using (t, c, l)"""
