"""Registered queries with the SQL each must agree with."""

import importlib
import pkgutil
from functools import cache

from textloom import plans
from textloom.functions import constants as K
from textloom.session import spread

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Tables with long text per row, and the key their rows are spread by.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark, sf_dir, name):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def dealt(spark, sf_dir, name, *columns):
    """Columns of a table of long texts, dealt by its key: grouping by the key, and by words of the text,
    needs no other shuffle, so the texts move once and their words never."""
    key = TEXT_KEYS[name]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *columns).repartition(key)


def lit(text):
    """SQL string literal; control characters go through chr()."""
    out = "'" + text.replace("'", "''") + "'"
    return out.replace("\x01", "'||chr(1)||'")


def sql_list(values):
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rewrite(expr, rules):
    """Nest regexp_replace calls for ordered rules; $1 becomes \\1."""
    for pattern, repl in rules:
        repl = repl.replace("$1", "\\1").replace("$2", "\\2")
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"
    return expr


def words(expr):
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda x: x <> '')"


STOP_CASE = (
    "CASE lang "
    + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in K.STOPWORDS.items())
    + " ELSE [] END"
)

# Long token table of the corpus: lower-cased words of two or more characters.
TOK = f"""tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term
  FROM documents)"""
TF = TOK + """, tf AS (
  SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"""


@cache
def load():
    """Import every plan module once so that it registers its queries."""
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"textloom.plans.{module.name}")
    return QUERIES, ORACLES
