"""Engine tables derived from the driver's tables, defined once in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scoutline.session import table

KINDS = "function,method,struct,enum,trait,impl,const,static,type,module,macro,variant,field,doc"

DEFS = {
    # 20 symbols to a file; files lie in five kinds of directory.
    "symbols": f"""
        SELECT p_partkey AS seq, concat(replace(p_name, ' ', '_'), '_', cast(p_partkey % 97 as string)) AS name,
               split_part('{KINDS}', ',', cast(p_partkey % 14 + 1 as int)) AS kind,
               concat('/proj/', split_part('src,tests,doc,notes,notes/benchmarks', ',', cast(cast(floor(p_partkey / 20) as bigint) % 5 + 1 as int)), '/m',
                      cast(cast(floor(p_partkey / 20) as bigint) as string), CASE WHEN cast(floor(p_partkey / 20) as bigint) % 5 < 2 THEN '.rs' ELSE '.md' END) AS file,
               cast(1 + (p_partkey % 20) * 30 + p_size % 7 as int) AS line, 1 AS col,
               split_part('pub,pub(crate),pub(super),', ',', cast(p_size % 4 + 1 as int)) AS visibility,
               CASE WHEN p_partkey % 14 IN (1, 11, 12) THEN concat('T', cast(p_partkey % 11 as string)) END AS parent,
               CASE WHEN p_partkey % 14 = 5 THEN concat('impl Trait', cast(p_partkey % 5 as string), ' for T', cast(p_partkey % 11 as string)) END AS signature,
               concat(p_name, ' ', p_type, ' ', p_brand) AS content
        FROM {{part}}""",
    "refs": """
        SELECT s.name AS name,
               concat('/proj/', split_part('src,tests,doc,notes,notes/benchmarks', ',', cast(cast(floor((l_partkey + l_linenumber) / 20) as bigint) % 5 + 1 as int)), '/m',
                      cast(cast(floor((l_partkey + l_linenumber) / 20) as bigint) as string), CASE WHEN cast(floor((l_partkey + l_linenumber) / 20) as bigint) % 5 < 2 THEN '.rs' ELSE '.md' END) AS file,
               cast(1 + (l_orderkey % 20) * 30 + l_linenumber as int) AS line, cast(l_linenumber as int) AS col,
               split_part('Call,Type,FieldAccess,Identifier,Call,Import', ',', cast(l_orderkey % 6 + 1 as int)) AS context
        FROM {lineitem} JOIN {symbols} s ON l_partkey = s.seq""",
    "files": """
        SELECT concat('/proj/', split_part('src,tests,doc,notes,notes/benchmarks,target', ',', cast(doc_id % 6 + 1 as int)), '/',
                      CASE WHEN doc_id % 9 = 0 THEN 'test_' ELSE '' END, 'f', cast(doc_id as string), CASE WHEN doc_id % 7 = 0 THEN '_test' ELSE '' END, '.',
                      split_part('rs,md,txt,ts,py,RS,lock', ',', cast(doc_id % 7 + 1 as int))) AS path,
               n_chars AS size, text AS content, doc_id AS mtime, CASE WHEN doc_id % 50 = 3 THEN 'unreadable' END AS error, doc_id % 13 AS symbol_count
        FROM {documents}""",
    "indexed_state": "SELECT concat('/p/f', cast(o_orderkey as string)) AS path, o_custkey AS mtime, cast(floor(o_totalprice) as bigint) AS size, o_orderkey % 10 AS symbol_count FROM {orders} WHERE o_orderkey % 10 <> 0",
    "current_state": "SELECT concat('/p/f', cast(o_orderkey as string)) AS path, o_custkey + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS mtime, cast(floor(o_totalprice) as bigint) + CASE WHEN o_orderkey % 8 = 3 THEN 1 ELSE 0 END AS size FROM {orders} WHERE o_orderkey % 7 <> 0",
    "questions": """
        SELECT item_id AS qid, concat(split_part('how does,where is,fix the,who calls,what is in,structure of,callers of,explain,find usages,what does', ',', cast(item_id % 10 + 1 as int)), ' ',
               CASE WHEN item_id % 3 = 0 THEN 'parse_config' WHEN item_id % 3 = 1 THEN 'SearchIndex' ELSE 'the widget module' END,
               CASE WHEN item_id % 10 = 9 THEN ' call' WHEN item_id % 4 = 2 THEN ' callers' WHEN item_id % 4 = 3 THEN ' structure' ELSE '' END) AS query
        FROM {benchmark}""",
    "terms": "SELECT seq AS qid, concat(replace(name, '_', ' '), ' ', split_part(content, ' ', 3)) AS query FROM {symbols} WHERE seq % 20 = 0",
    # Queries in the syntax of text search, five forms.
    "syntax": """
        SELECT seq AS qid, seq % 5 AS form, t1, t2, c, CASE seq % 5 WHEN 0 THEN concat(t1, '_', t2) WHEN 1 THEN concat('+', t1, ' ', t2) WHEN 2 THEN concat(t1, ' -', t2)
               WHEN 3 THEN concat('name:', t1, ' AND content:', c) ELSE concat('"', t1, ' ', t2, '" OR nowhere:', c) END AS query
        FROM (SELECT cast(floor(seq / 20) as bigint) AS seq, split_part(name, '_', 1) AS t1, split_part(name, '_', 2) AS t2, split_part(content, ' ', 3) AS c FROM {symbols} WHERE seq % 20 = 0)""",
    # Three words of a name and one of the content, for queries in the further syntax; a question for every twentieth symbol.
    "words": """
        SELECT seq AS qid, split_part(name, '_', 1) AS t1, split_part(name, '_', 2) AS t2, split_part(name, '_', 3) AS t3, lower(split_part(content, ' ', 6)) AS c FROM {symbols} WHERE seq % 20 = 0""",
    # Rust files of up to four functions, some with bodies of more than 500 bytes.
    "rust": f"""
        SELECT doc_id, concat('/src/m', cast(doc_id as string), '.rs') AS path, concat(CASE WHEN doc_id % 2 = 0 THEN concat('//! Module ', cast(doc_id as string)) ELSE 'use std::fmt;' END, chr(10), {", ".join(
            f"CASE WHEN doc_id % 5 >= {i} THEN concat('/// Doc {i} of ', cast(doc_id as string), chr(10), '#[inline]', chr(10), body{i}, chr(10)) ELSE '' END" for i in range(1, 5))}) AS content
        FROM {{rust_bodies}}""",
    # Texts with braces over many lines, and a line in each.
    "braced": """
        SELECT doc_id, cast(doc_id % 9 + 1 as int) AS line, replace(replace(text, CASE WHEN doc_id % 3 = 0 THEN ' of ' WHEN doc_id % 3 = 1 THEN 'e ' ELSE ', ' END, concat(' ', chr(123), chr(10))), CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE 'n ' END, concat(chr(10), chr(125))) AS content
        FROM {documents}""",
    "rust_bodies": "SELECT doc_id, " + ", ".join(
        f"concat('pub fn f{i}_', cast(doc_id as string), '(x: T', cast(doc_id % 3 as string), ') -> u32 ', chr(123), ' g{i}(x.a); let s = \"', repeat('é ', cast(doc_id % 7 * {60 * i} as int)), '\"; 7 ', chr(125)) AS body{i}" for i in range(1, 5)) + " FROM {documents}",
    "interactions": """
        SELECT concat(cast(u.conv_id as string), '-', cast(u.turn as string)) AS id, cast(u.conv_id % 20 as string) AS session_id, u.conv_id * 10 + u.turn AS timestamp,
               u.turn + u.conv_id * 100 AS line_no, u.text AS input_text, a.text AS response_text,
               CASE WHEN u.turn % 3 = 0 THEN 'Answer' WHEN u.turn % 3 = 1 THEN 'Question' ELSE 'CodeChange' END AS type
        FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "tickets": """
        SELECT concat(split_part('ABC,OPS,WEB', ',', cast(o_custkey % 3 + 1 as int)), '-', cast(o_orderkey as string)) AS key, concat('Fix ', o_orderpriority, ' in part ', cast(o_orderkey % 30 as string)) AS summary,
               CASE WHEN o_custkey % 5 <> 0 THEN concat('User ', cast(o_custkey % 17 as string)) END AS assignee,
               CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderkey % 9 as double) / 2 END AS points,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Backlog' ELSE concat('Team ', cast(o_orderkey % 12 as string), ' - Q', cast(o_orderkey % 4 + 1 as string), ' ', cast(2020 + o_orderkey % 5 as string)) END AS sprint,
               CASE WHEN o_orderkey % 3 = 0 THEN 'active' ELSE 'closed' END AS sprint_state, o_orderkey AS pos
        FROM {orders}""",
    "issues": """
        SELECT l_orderkey * 10 + l_linenumber AS id, split_part('critical,high,medium,low', ',', cast(l_orderkey % 4 + 1 as int)) AS severity, cast(l_quantity as int) AS severity_score,
               CASE WHEN l_returnflag = 'N' THEN 'open' ELSE 'closed' END AS status, concat('repo', cast(l_suppkey as string)) AS repo, split_part('sast,sca,leak', ',', cast(l_partkey % 3 + 1 as int)) AS type
        FROM {lineitem}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or a plain table."""
    if name not in DEFS:
        return table(spark, sf_dir, name)
    used = sorted(set(re.findall(r"\{(\w+)\}", DEFS[name])))
    return spark.sql(DEFS[name], **{x: frame(spark, sf_dir, x) for x in used})


def cte(*names: str) -> str:
    """The same tables as a WITH clause for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in DEFS and name not in order:
            for x in re.findall(r"\{(\w+)\}", DEFS[name]):
                add(x)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', DEFS[n])})" for n in order) + "\n"
