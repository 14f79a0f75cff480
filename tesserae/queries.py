"""The engine's own queries over the star-schema tables and the events log, each with the same in SQL.

DATALOG has those that are one Datalog text: tables, text, options, SQL. Others are functions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.database import Database, WideDatabase, run_query
from tesserae.operators.temporal import holding
from tesserae.shared import shared_dir
from tesserae.sources.base import LogFacts
from tesserae.sources.catalogue import tables
from tesserae.sources.edn import Fact
from tesserae.sources.schema import FOREVER, LOG_SCHEMA, MANY, VALUE_TYPES, Catalog
from tesserae.sources.wire import CAS_COLUMNS

FLAGSHIP = "[:find ?seg (sum ?tot) :where [?c :customer/segment ?seg] [?o :order/customer ?c] [?o :order/total ?tot]]"
_C, _O, _L, _N, _D, _P = ["customer"], ["orders"], ["lineitem"], ["nation", "region"], ["documents", "labels"], ["part"]
PRIOR = "[[(before ?x ?y) [?x :turn/prev ?y]] [(before ?x ?y) [?x :turn/prev ?z] (before ?z ?y)]]"
PLACES = '[[(in-region ?c ?r) [?c :customer/nation ?n] [?n :nation/region ?r]]]'
RICH = '[[(big ?o) [?o :order/total ?t] [(> ?t 250000.0)]] [(big ?o) [?o :order/priority "1-URGENT"]]]'

DATALOG: dict[str, tuple[list[str], str, dict[str, Any], str]] = {
    "s_scan_parquet": (_N, "[:find ?n ?name ?r :where [?n :nation/name ?name] [?n :nation/region ?r]]", {}, "SELECT n_nationkey::BIGINT AS n, n_name AS name, n_regionkey::BIGINT AS r FROM nation"),
    "d_pattern_literal_e": (_C, "[:find ?n ?b :where [17 :customer/name ?n] [17 :customer/acctbal ?b]]", {}, "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 17"),
    "d_pattern_literal_string": (_C, '[:find ?c :where [?c :customer/segment "BUILDING"]]', {}, "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "d_pattern_literal_int": (_P, "[:find ?p ?b :where [?p :part/size 15] [?p :part/brand ?b]]", {}, "SELECT p_partkey AS p, p_brand AS b FROM part WHERE p_size = 15"),
    "d_pattern_literal_float": (_L, "[:find (count ?i) :where [?i :item/discount 0.05]]", {}, "SELECT count(*) AS count_i FROM lineitem WHERE l_discount = 0.05"),
    "d_pattern_literal_ref": (_N, "[:find ?name :where [?n :nation/region 2] [?n :nation/name ?name]]", {}, "SELECT n_name AS name FROM nation WHERE n_regionkey = 2"),
    "d_attr_var": (["nation"], "[:find ?a (count ?n) :where [?n ?a ?v]]", {}, "SELECT a, count(*) AS count_n FROM (SELECT 100::BIGINT AS a FROM nation UNION ALL SELECT 101 FROM nation) GROUP BY a"),
    "d_poly_value": (["nation"], "[:find ?n ?v :where [?n ?a ?v]]", {}, "SELECT n_nationkey::BIGINT AS n, n_name AS v FROM nation UNION ALL SELECT n_nationkey, n_regionkey::VARCHAR FROM nation"),
    "d_tx_op_terms": (["nation"], "[:find ?n ?tx ?op :where [?n :nation/name _ ?tx ?op]]", {}, "SELECT n_nationkey::BIGINT AS n, 0::BIGINT AS tx, true AS op FROM nation"),
    "d_implicit_join_2": ([*_C, *_O], "[:find ?o ?name :where [?o :order/customer ?c] [?c :customer/name ?name]]", {}, "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "d_implicit_join_4": ([*_C, *_O, *_N], "[:find ?r (count ?o) :where [?o :order/customer ?c] [?c :customer/nation ?n] [?n :nation/region ?g] [?g :region/name ?r]]", {}, "SELECT r_name AS r, count(*) AS count_o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "d_star_collapse": (_L, "[:find ?f ?s (count ?q) (max ?p) :where [?i :item/flag ?f] [?i :item/status ?s] [?i :item/quantity ?q] [?i :item/price ?p]]", {}, "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS count_q, max(l_extendedprice) AS max_p FROM lineitem GROUP BY 1, 2"),
    "d_repeated_attribute": (["nation"], "[:find ?x ?y :where [?n :nation/name ?x] [?n :nation/name ?y]]", {}, "SELECT n_name AS x, n_name AS y FROM nation"),
    "d_cross_product": (_N, "[:find ?a ?b :where [?n :nation/name ?a] [?r :region/name ?b]]", {}, "SELECT n_name AS a, r_name AS b FROM nation CROSS JOIN region"),
    "d_pred_lt": (_C, "[:find ?c :where [?c :customer/acctbal ?b] [(< ?b 0.0)]]", {}, "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0"),
    "d_pred_range": (_O, "[:find ?o ?t :where [?o :order/total ?t] [(>= ?t 100000.0)] [(<= ?t 120000.0)]]", {}, "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000"),
    "d_pred_ne": (_O, '[:find ?o :where [?o :order/status ?s] [(!= ?s "F")]]', {}, "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'F'"),
    "d_pred_eq": (_O, '[:find ?o :where [?o :order/status ?s] [(= ?s "P")]]', {}, "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'P'"),
    "d_pred_cross_relation": (["supplier", "customer"], "[:find ?s (count ?c) :where [?s :supplier/nation ?n] [?c :customer/nation ?n] [?s :supplier/acctbal ?a] [?c :customer/acctbal ?b] [(< ?a ?b)]]", {}, "SELECT s_suppkey AS s, count(*) AS count_c FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal GROUP BY s_suppkey"),
    "d_arith_add_mul": (_L, "[:find ?i ?y :where [?x :item/order ?i] [?x :item/number ?n] [(* ?n 10) ?m] [(+ ?m 3) ?y]]", {}, "SELECT l_orderkey AS i, l_linenumber::BIGINT * 10 + 3 AS y FROM lineitem"),
    "d_arith_int_div": (_P, "[:find ?p ?h :where [?p :part/size ?s] [(- ?s 20) ?d] [(/ ?d 3) ?h]]", {}, "SELECT p_partkey AS p, (p_size::BIGINT - 20) // 3 AS h FROM part"),
    "d_arith_float_div": (_P, "[:find ?p ?h :where [?p :part/price ?s] [(/ ?s 4) ?h]]", {}, "SELECT p_partkey AS p, p_retailprice / 4 AS h FROM part"),
    "d_str_concat": (_N, '[:find ?x :where [?n :nation/name ?a] [?n :nation/region ?r] [?r :region/name ?b] [(str ?b "/" ?a) ?x]]', {}, "SELECT concat(r_name, '/', n_name) AS x FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "d_fn_upper": (_N, "[:find ?u ?l :where [?r :region/name ?n] [(lower ?n) ?u] [(length ?n) ?k] [(+ ?k 0) ?l]]", {}, "SELECT lower(r_name) AS u, length(r_name)::BIGINT AS l FROM region"),
    "d_fn_substr": (_C, "[:find ?c ?x :where [?c :customer/segment ?s] [(substr ?s 1 3) ?x]]", {}, "SELECT c_custkey AS c, substr(c_mktsegment, 1, 3) AS x FROM customer"),
    "d_fn_date_trunc": (_O, '[:find ?m (count ?o) :where [?o :order/date ?d] [(date_trunc "month" ?d) ?m]]', {}, "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS count_o FROM orders GROUP BY 1"),
    "d_fn_as_predicate": (_C, '[:find ?c :where [?c :customer/segment ?s] [(starts_with ?s "A")]]', {}, "SELECT c_custkey AS c FROM customer WHERE c_mktsegment LIKE 'A%'"),
    "d_fn_numeric": (_P, "[:find ?p ?x :where [?p :part/price ?v] [(floor ?v) ?x]]", {}, "SELECT p_partkey AS p, floor(p_retailprice)::BIGINT AS x FROM part"),
    "d_bind_unify": (_P, "[:find ?p :where [?p :part/size ?s] [(+ ?p 0) ?s]]", {}, "SELECT p_partkey AS p FROM part WHERE p_partkey = p_size"),
    "d_bind_tuple": (_P, "[:find ?p ?x ?y :where [?p :part/size ?s] [(+ ?s 1) ?t] [(make_array ?s ?t) [?x ?y]]]", {}, "SELECT p_partkey AS p, p_size::BIGINT AS x, p_size::BIGINT + 1 AS y FROM part"),
    "d_bind_relation": (_P, "[:find ?p ?x :where [?p :part/size ?s] [(+ ?s 100) ?t] [(make_array ?s ?t) [[?x]]]]", {}, "SELECT p_partkey AS p, p_size::BIGINT AS x FROM part UNION ALL SELECT p_partkey, p_size::BIGINT + 100 FROM part"),
    "d_literal_tx": (["nation"], "[:find ?x :where [?n :nation/name ?x 0]]", {}, "SELECT n_name AS x FROM nation"),
    "d_literal_op": (["nation"], "[:find ?x :where [?n :nation/name ?x _ true] [?n :nation/region 3]]", {}, "SELECT n_name AS x FROM nation WHERE n_regionkey = 3"),
    "d_fn_log": (_P, "[:find ?p ?l :where [?p :part/size ?s] [(log ?s) ?l]]", {}, "SELECT p_partkey AS p, round(log10(p_size), 6) AS l FROM part"),
    "d_fn_concat": (_D, '[:find ?d ?x :where [?d :doc/lang ?l] [?d :doc/source ?s] [(concat ?l "-" ?s) ?x]]', {}, "SELECT doc_id AS d, concat(lang, '-', source) AS x FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"),
    "d_lineitem_two_relations": (_L, '[:find ?o ?n ?q :where [?i :item/order ?o] (or-join [?i] [?i :item/flag "R"] [?i :item/status "F"]) [?i :item/number ?n] [?i :item/quantity ?q]]', {}, "SELECT l_orderkey AS o, l_linenumber::BIGINT AS n, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F'"),
    "d_or": (_O, '[:find ?o :where (or [?o :order/status "P"] [?o :order/priority "1-URGENT"])]', {}, "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'"),
    "d_or_join": (_O, '[:find ?o ?t :where [?o :order/total ?t] (or-join [?o] [?o :order/status "P"] [?o :order/priority "5-LOW"])]', {}, "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'"),
    "d_or_predicates": (_P, "[:find ?p :where [?p :part/size ?s] (or [(< ?s 5)] [(> ?s 45)])]", {}, "SELECT p_partkey AS p FROM part WHERE p_size < 5 OR p_size > 45"),
    "d_not": (_D, "[:find ?d :where [?d :doc/lang ?l] (not [?d :doc/quality ?q])]", {}, "SELECT doc_id AS d FROM documents WHERE lang IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    "d_not_multi": (_D, "[:find ?d ?l :where [?d :doc/lang ?l] (not [?d :doc/quality 1] [?d :doc/toxic 0])]", {}, "SELECT doc_id AS d, lang AS l FROM documents d WHERE lang IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)"),
    "d_not_join": ([*_C, *_O], '[:find ?c :where [?c :customer/segment "BUILDING"] (not-join [?c] [?o :order/customer ?c] [?o :order/status "P"])]', {}, "SELECT c_custkey AS c FROM customer c WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "d_in_scalar": (_C, "[:find ?c ?s :in $ ?s :where [?c :customer/segment ?s]]", {"inputs": ["MACHINERY"]}, "SELECT c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "d_in_collection": (_P, "[:find ?p ?z :in [?z ...] :where [?p :part/size ?z]]", {"inputs": [[1, 7, 49]]}, "SELECT p_partkey AS p, p_size::BIGINT AS z FROM part WHERE p_size IN (1, 7, 49)"),
    "d_in_tuple": (_O, "[:find ?o :in [?s ?p] :where [?o :order/status ?s] [?o :order/priority ?p]]", {"inputs": [("F", "2-HIGH")]}, "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'"),
    "d_in_relation": (_O, "[:find ?o ?s ?p :in [[?s ?p]] :where [?o :order/status ?s] [?o :order/priority ?p]]", {"inputs": [[("F", "2-HIGH"), ("P", "5-LOW")]]}, "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"),
    "d_rule_simple": ([*_C, *_N], "[:find ?r (count ?c) :where (in-region ?c ?r)]", {"rules": PLACES}, "SELECT n_regionkey::BIGINT AS r, count(*) AS count_c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "d_rule_multi_def": (_O, "[:find (count ?o) :where (big ?o)]", {"rules": RICH}, "SELECT count(*) AS count_o FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "d_rule_recursive": (["turns"], "[:find ?x ?y :where (before ?x ?y)]", {"rules": PRIOR}, "SELECT a.conv_id * 16777216 + a.turn AS x, b.conv_id * 16777216 + b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn"),
    "d_rule_recursive_bound": (["turns"], "[:find ?y :where (before 201326597 ?y)]", {"rules": PRIOR}, "SELECT 201326592 + turn AS y FROM conversations WHERE conv_id = 12 AND turn < 5 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 12 AND turn = 5)"),
    "a_count": (_D, "[:find (count ?q) :where [?d :doc/quality ?q]]", {}, "SELECT count(quality) AS count_q FROM labels"),
    "a_sum": (_L, "[:find (sum ?n) :where [?i :item/number ?n]]", {}, "SELECT sum(l_linenumber)::BIGINT AS sum_n FROM lineitem"),
    "a_avg": (_P, "[:find ?b (avg ?s) :where [?p :part/brand ?b] [?p :part/size ?s]]", {}, "SELECT p_brand AS b, avg(p_size) AS avg_s FROM part GROUP BY 1"),
    "a_mean": (_P, "[:find ?b (mean ?v) :where [?p :part/brand ?b] [?p :part/price ?v]]", {}, "SELECT p_brand AS b, round(avg(p_retailprice), 6) AS mean_v FROM part GROUP BY 1"),
    "a_stddev": (_P, "[:find ?b (stddev ?s) (stddev_pop ?s) :where [?p :part/brand ?b] [?p :part/size ?s]]", {}, "SELECT p_brand AS b, round(stddev_samp(p_size), 6) AS stddev_s, round(stddev_pop(p_size), 6) AS stddev_pop_s FROM part GROUP BY 1"),
    "a_variance": (_P, "[:find ?b (var_samp ?s) (var_pop ?s) :where [?p :part/brand ?b] [?p :part/size ?s]]", {}, "SELECT p_brand AS b, round(var_samp(p_size), 6) AS var_samp_s, round(var_pop(p_size), 6) AS var_pop_s FROM part GROUP BY 1"),
    "a_min_max": (_O, "[:find ?s (min ?t) (max ?t) :where [?o :order/status ?s] [?o :order/total ?t]]", {}, "SELECT o_orderstatus AS s, min(o_totalprice) AS min_t, max(o_totalprice) AS max_t FROM orders GROUP BY 1"),
    "a_median": (_P, "[:find (median ?s) :where [?p :part/size ?s]]", {}, "SELECT median(p_size) AS median_s FROM part"),
    "a_bool": (_O, '[:find ?s (bool_or ?b) (bool_and ?b) :where [?o :order/status ?s] [?o :order/total ?t] [(> ?t 1000.0) ?b]]', {}, "SELECT o_orderstatus AS s, bool_or(o_totalprice > 1000) AS bool_or_b, bool_and(o_totalprice > 1000) AS bool_and_b FROM orders GROUP BY 1"),
    "a_approx_distinct": (_O, "[:find (approx_distinct ?c) :where [?o :order/customer ?c]]", {}, ""),
    "a_count_distinct": (_O, "[:find ?s (count-distinct ?c) :where [?o :order/customer ?c] [?o :order/status ?s]]", {}, 'SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS "count-distinct_c" FROM orders GROUP BY 1'),
    "a_group_by_multi": (_O, "[:find ?s ?p (count ?o) :where [?o :order/status ?s] [?o :order/priority ?p]]", {}, "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS count_o FROM orders GROUP BY 1, 2"),
    "a_global_empty": (_P, "[:find (count ?p) (max ?s) :where [?p :part/size ?s] [(> ?s 1000)]]", {}, "SELECT 0::BIGINT AS count_p, NULL::BIGINT AS max_s"),
    "fp_entity_range": (_C, "[:find ?c ?n :where [?c :customer/name ?n] [(>= ?c 100)] [(< ?c 200)]]", {}, "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey >= 100 AND c_custkey < 200"),
    "fp_value_range": (_P, "[:find ?p ?s :where [?p :part/size ?s] [(>= ?s 30)] [(<= ?s 40)]]", {}, "SELECT p_partkey AS p, p_size::BIGINT AS s FROM part WHERE p_size BETWEEN 30 AND 40"),
    "fp_bitmap_join": (_C, '[:find ?n :where [?c :customer/segment "FURNITURE"] [?c :customer/name ?n]]', {}, "SELECT c_name AS n FROM customer WHERE c_mktsegment = 'FURNITURE'"),
}


#: Results that are rounded, as sums in another order differ in the last digits.
ROUNDED = {"a_mean": ("mean_v",), "d_fn_log": ("l",), "a_stddev": ("stddev_s", "stddev_pop_s"), "a_variance": ("var_samp_s", "var_pop_s")}


def _datalog(names: list[str], text: str, options: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: WideDatabase(spark, tables(spark, sf_dir, names)).query(text, **options)


def _rounded(query: Callable[[SparkSession, str], DataFrame], columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return (lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, 6) for c in columns})) if columns else query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = WideDatabase(spark, tables(spark, sf_dir, ["customer", "orders"])).query(FLAGSHIP)
    return found.select("seg", F.round("sum_tot", 2).alias("sum_tot"))


def p_pull_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = WideDatabase(spark, tables(spark, sf_dir, ["customer", "nation", "region"]))
    found = db.query('[:find ?c (pull ?c [:customer/name {:customer/nation [:nation/name {:nation/region [:region/name]}]}]) :where [?c :customer/segment "BUILDING"]]')
    tree = F.col("pull_c")
    nation = tree[":customer/nation"]
    return found.select("c", tree[":customer/name"].alias("name"), nation[":nation/name"].alias("nation"), nation[":nation/region"][":region/name"].alias("region"))


def p_pull_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = WideDatabase(spark, tables(spark, sf_dir, ["documents", "labels"]))
    found = db.query('[:find ?d (pull ?d [:doc/lang :doc/quality]) :where [?d :doc/lang "fr"]]')
    return found.select("d", F.col("pull_d")[":doc/lang"].alias("lang"), F.col("pull_d")[":doc/quality"].cast("long").alias("quality"))


def p_pull_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON."""
    from tesserae.sources.formats import json_rows

    return json_rows(WideDatabase(spark, tables(spark, sf_dir, ["nation", "region"])).query("[:find ?n (pull ?n [*]) :where [?n :nation/region 1]]"))


def p_pull_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity is a constant of the clause."""
    found = WideDatabase(spark, tables(spark, sf_dir, ["customer"])).query("[:find (pull ?c [:customer/name :customer/segment :customer/acctbal]) :where [42 :customer/name _]]")
    return found.select(*[F.col("pull_c")[f":customer/{c}"].alias(c) for c in ("name", "segment", "acctbal")])


def a_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = WideDatabase(spark, tables(spark, sf_dir, ["nation"])).query("[:find ?r (array_agg ?x) :where [?n :nation/region ?r] [?n :nation/name ?x]]")
    return found.select("r", F.array_join(F.array_sort("array_agg_x"), ",").alias("names"))


# The events as a log: a user's event type from one event to the next, valid from the event's time, in transaction event_id.

EVENT_CATALOG = Catalog().with_new(":user/event", "String").with_new(":user/value", "Float64").with_new(":user/kinds", "String", cardinality=MANY)


def event_log(spark: SparkSession, sf_dir: str, ident: str = ":user/event") -> DataFrame:
    """The events table as rows of the log; :user/kinds keeps each type a user has ever had."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = EVENT_CATALOG.get(ident)
    value = F.col("value") if a.value_type == "Float64" else F.col("event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    typed = [(value if c == a.column else F.lit(None).cast(k)).alias(c) for c, k in VALUE_TYPES.values()]
    return events.select(F.col("user_id").alias("e"), F.lit(a.id).alias("a"), *typed, F.col("event_id").alias("t"), F.lit(True).alias("op"), at.alias("valid_from"), F.lit(FOREVER).cast("long").alias("valid_to"), F.lit(0).cast("long").alias("seq")).select(*LOG_SCHEMA.names)


class EventFacts(LogFacts):
    """Queries over the events without a store: the log is the table."""

    def __init__(self, spark: SparkSession, sf_dir: str, ts: int | None = None, history: bool = False):
        self.spark, self.sf_dir, self.ts, self.history = spark, sf_dir, ts, history

    def attribute(self, ident: str):
        return EVENT_CATALOG.get(ident)

    def rows(self, attributes: list[int] | None = None) -> DataFrame:
        own = [a for a in EVENT_CATALOG.attributes if attributes is None or a.id in attributes]
        log = event_log(self.spark, self.sf_dir, own[0].ident)
        for a in own[1:]:
            log = log.unionByName(event_log(self.spark, self.sf_dir, a.ident))
        if self.history:
            return log
        return holding(log, [a.id for a in own if a.cardinality == MANY], self.ts)


def _events(text: str, **view: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(spark, EventFacts(spark, sf_dir, **view), text)


def t_compaction_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current events out of a store: most compacted, every tenth event written after that."""
    from dataclasses import replace

    store = _fresh(spark, "events").store
    log, cut = event_log(spark, sf_dir), "t % 10 != 0"
    store.commit(replace(store.manifest(), log=(store.write(log.where(cut), "log"),), catalog=EVENT_CATALOG, last_tx=1))
    m = store.compact()
    store.commit(replace(m, log=(*m.log, store.write(log.where(f"NOT ({cut})"), "log"))))
    return run_query(spark, LogFacts(store, store.manifest()), "[:find ?u ?k :where [?u :user/event ?k]]")


def t_compaction_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current events out of a store of layers of intervals, each of fewer users than the one below, and what was written since."""
    from dataclasses import replace

    store = _fresh(spark, "layers").store
    log = event_log(spark, sf_dir)
    store.commit(replace(store.manifest(), catalog=EVENT_CATALOG, last_tx=1))
    # Later parts hold some events of a tenth, then of a hundredth of the users, whose earlier ones lie below.
    part = "CASE WHEN pmod(xxhash64(e), 100) = 0 THEN pmod(xxhash64(e, t, seq), 4) WHEN pmod(xxhash64(e), 100) < 10 THEN pmod(xxhash64(e, t, seq), 2) ELSE 0 END"
    for i in range(4):
        m = store.manifest()
        store.commit(replace(m, log=(*m.log, store.write(log.where(f"{part} = {i}"), "log"))))
        if i < 3:
            store.compact()
    return run_query(spark, LogFacts(store, store.manifest()), "[:find ?u ?k :where [?u :user/event ?k]]")


def _fresh(spark: SparkSession, name: str) -> Database:
    import uuid

    return Database(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _wire(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    for c in ["op", "valid_time", *[c for c, _ in VALUE_TYPES.values()], *CAS_COLUMNS]:
        if c not in have:
            kind = "boolean" if c in ("op", "v_bool", "cas_bool") else "string" if c.endswith("_str") else "double" if c.endswith("_float") else "binary" if c.endswith("_uuid") else "bigint"
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return rows


def w_transact_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity 0 means the transaction, so a part is its key plus one. Each part's size is written, then that of every third part again; history tells all."""
    db = _fresh(spark, "overwrite")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select((F.col("p_partkey") + 1).alias("e"), F.lit(":part/size").alias("ident"), F.col("p_size").cast("long").alias("v_int"))
    db.transact(_wire(rows), 100)
    db.transact(_wire(rows.where("e % 3 = 0").withColumn("v_int", F.col("v_int") + 100)), 200)
    return db.history("[:find ?p ?s ?tx ?op :where [?p :part/size ?s ?tx ?op]]")


def w_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's segment is written; those of every fifth are retracted, and retracting what is not held does nothing."""
    db = _fresh(spark, "retract")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 1).alias("e"), F.lit(":customer/segment").alias("ident"), F.col("c_mktsegment").alias("v_str"))
    db.transact(_wire(rows), 100)
    gone = rows.where("e % 5 = 0").withColumn("op", F.lit(False))
    db.transact(_wire(gone.unionByName(rows.where("e % 5 = 1").withColumn("v_str", F.lit("nothing")).withColumn("op", F.lit(False)))), 200)
    return db.query("[:find ?c ?s :where [?c :customer/segment ?s]]")


def w_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A swap with a wrong expectation writes nothing; one with the right one does."""
    from tesserae.errors import CompareAndSwapFailed

    db = _fresh(spark, "cas")
    db.transact([Fact(1, ":a/state", "old")], 100)
    try:
        db.transact([Fact(1, ":a/state", "lost", expect="other")], 200)
    except CompareAndSwapFailed:
        db.transact([Fact(1, ":a/state", "new", expect="old")], 300)
    return db.query("[:find ?e ?s :where [?e :a/state ?s]]")


def w_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique value with another owner is refused at its owner's times, and free after."""
    from tesserae.errors import UniqueConstraintViolation

    db = _fresh(spark, "unique")
    db.add_attribute(":a/key", "String", unique=True, now=1)
    db.transact([Fact(1, ":a/key", "k")], 100)
    for e, at in ((2, 150), (3, 50)):
        try:
            db.transact([Fact(e, ":a/key", "k", valid_time=at)], 200)
        except UniqueConstraintViolation:
            pass
    db.transact([Fact(1, ":a/key", "k", op=False)], 300)
    db.transact([Fact(4, ":a/key", "k")], 400)
    return db.query("[:find ?e ?k :where [?e :a/key ?k]]")


def s_edn_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region is written by an EDN map, its kind by an EDN assertion that a retraction and another one follow."""
    db = _fresh(spark, "edn")
    names = {r[0] + 1: r[1] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()}
    db.transact("[" + " ".join(f'{{:db/id {k} :place/name "{n}"}} [:db/add {k} :place/kind "new"]' for k, n in names.items()) + "]", 100)
    db.transact("[" + " ".join(f'[:db/retract {k} :place/kind "new"]' for k in names) + "]", 200)
    db.transact("[" + " ".join(f'[:db/add {k} :place/kind "{"odd" if k % 2 else "even"}"]' for k in names) + "]", 300)
    return db.query("[:find ?r ?n ?k :where [?r :place/name ?n] [?r :place/kind ?k]]")


def s_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    db = _fresh(spark, "json")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()
    facts = [{"e": r[0] + 1, "ident": i, "v": v, "op": True} for r in rows for i, v in ((":land/name", r[1]), (":land/region", r[2]))]
    db.transact_json(json.dumps({"facts": facts, "tx_time": 500}))
    return db.query("[:find ?n ?x ?r :where [?n :land/name ?x] [?n :land/region ?r]]")


def s_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers come as a stream, of which each micro-batch is a transaction."""
    from tesserae.streaming.ingest import ingest

    db = _fresh(spark, "stream")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    # A stream reads folders or patterns, not a file by its name.
    stream = spark.readStream.schema(supplier.schema).parquet(f"{sf_dir}/supplier.parque[t]")
    rows = stream.select((F.col("s_suppkey") + 1).cast("long").alias("e"), F.lit(":supplier/balance").alias("ident"), F.col("s_acctbal").cast("double").alias("v_float"))
    ingest(db, _wire(rows), f"{db.store.path}-checkpoint", 100).awaitTermination()
    return db.query("[:find ?s ?b ?tx :where [?s :supplier/balance ?b ?tx]]")


_EV = "SELECT user_id AS u, event_type AS k, event_id AS t, epoch_us(ts) AS f, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
AS_OF = 1_704_500_000_000_000

FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, "SELECT c_mktsegment AS seg, round(sum(o_totalprice), 2) AS sum_tot FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "p_pull_simple": (p_pull_simple, "SELECT d.doc_id AS d, lang, quality::BIGINT AS quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE lang = 'fr'"),
    "p_pull_nested": (p_pull_nested, "SELECT c_custkey AS c, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'"),
    "a_array_agg": (a_array_agg, "SELECT n_regionkey::BIGINT AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "s_edn_ingest": (s_edn_ingest, "SELECT r_regionkey + 1 AS r, r_name AS n, 'even' AS k FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT r_regionkey + 1, r_name, 'odd' FROM region WHERE r_regionkey % 2 = 0"),
    "s_json_ingest": (s_json_ingest, "SELECT n_nationkey + 1 AS n, n_name AS x, n_regionkey::BIGINT AS r FROM nation"),
    "s_stream_ingest": (s_stream_ingest, "SELECT s_suppkey + 1 AS s, s_acctbal AS b, 1::BIGINT AS tx FROM supplier"),
    "p_pull_constant": (p_pull_constant, "SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer WHERE c_custkey = 42"),
    "p_pull_wildcard": (p_pull_wildcard, "SELECT '{\"n\":' || n_nationkey || ',\"pull_n\":{\"nation/name\":\"' || n_name || '\",\"nation/region\":' || n_regionkey || coalesce(',\"region/name\":\"' || r_name || '\"', '') || '}}' AS json FROM nation LEFT JOIN region ON r_regionkey = n_nationkey WHERE n_regionkey = 1"),
    "t_now": (_events("[:find ?u ?k :where [?u :user/event ?k]]"), f"SELECT u, k FROM ({_EV}) WHERE n IS NULL"),
    "t_as_of": (_events("[:find ?u ?k :where [?u :user/event ?k]]", ts=AS_OF), f"SELECT u, k FROM ({_EV}) WHERE f <= {AS_OF} AND (n IS NULL OR n > {AS_OF})"),
    "t_history": (_events("[:find ?u ?k ?tx :where [?u :user/event ?k ?tx]]", history=True), "SELECT user_id AS u, event_type AS k, event_id AS tx FROM events"),
    "t_history_ops": (_events("[:find ?u (count ?k) :where [?u :user/event ?k _ true]]", history=True), "SELECT user_id AS u, count(*) AS count_k FROM events GROUP BY 1"),
    "t_star_now": (_events("[:find ?u ?k ?v :where [?u :user/event ?k] [?u :user/value ?v]]"), "SELECT user_id AS u, arg_max(event_type, ts) AS k, arg_max(value, ts) AS v FROM events GROUP BY 1"),
    "t_temporal_self_join": (_events('[:find ?u (count ?t1) :where [?u :user/event "view" ?t1] [?u :user/event "purchase" ?t2] [(< ?t1 ?t2)]]', history=True), "SELECT a.user_id AS u, count(*) AS count_t1 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY 1"),
    "t_card_many_now": (_events("[:find ?u ?k :where [?u :user/kinds ?k]]"), "SELECT DISTINCT user_id AS u, event_type AS k FROM events"),
    "t_compaction_equiv": (t_compaction_equiv, f"SELECT u, k FROM ({_EV}) WHERE n IS NULL"),
    "t_compaction_layers": (t_compaction_layers, f"SELECT u, k FROM ({_EV}) WHERE n IS NULL"),
    "w_transact_overwrite": (w_transact_overwrite, "SELECT p_partkey + 1 AS p, p_size::BIGINT AS s, 1::BIGINT AS tx, true AS op FROM part UNION ALL SELECT p_partkey + 1, p_size, 2, false FROM part WHERE (p_partkey + 1) % 3 = 0 UNION ALL SELECT p_partkey + 1, p_size + 100, 2, true FROM part WHERE (p_partkey + 1) % 3 = 0"),
    "w_retract": (w_retract, "SELECT c_custkey + 1 AS c, c_mktsegment AS s FROM customer WHERE (c_custkey + 1) % 5 <> 0"),
    "w_cas": (w_cas, "SELECT 1::BIGINT AS e, 'new' AS s"),
    "w_unique": (w_unique, "SELECT 4::BIGINT AS e, 'k' AS k"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _rounded(_datalog(names, text, options), ROUNDED.get(n, ())) for n, (names, text, options, _) in DATALOG.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: x[-1] for n, x in {**DATALOG, **FUNCTIONS}.items() if x[-1]}
