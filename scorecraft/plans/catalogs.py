"""Tool catalogues that go with the fixtures."""

from __future__ import annotations

from pyspark.sql import SparkSession

from scorecraft.sources.catalog import catalog_documents, tool_params_dim, tools_dim

# Fixed catalogue matching the F-B fixture: the three chart tools, each with
# parameters data_source, payees and title.
FIXTURE_CATALOG = """
[
 {"type": "function", "function": {"name": "show_pie_chart", "description": "Spending or income breakdown",
   "parameters": {"type": "object", "properties": {
     "data_source": {"type": "object"}, "payees": {"type": "array"}, "title": {"type": "string"}}}}},
 {"type": "function", "function": {"name": "show_stacked_bar_chart", "description": "Stacked bars over time",
   "parameters": {"type": "object", "properties": {
     "data_source": {"type": "object"}, "payees": {"type": "array"}, "title": {"type": "string"}}}}},
 {"type": "function", "function": {"name": "show_line_chart", "description": "Trends over time",
   "parameters": {"type": "object", "properties": {
     "data_source": {"type": "object"}, "payees": {"type": "array"}, "title": {"type": "string"}}}}}
]
"""

# Catalogue of the argument-domain report: freight tools with plain enums and
# rules under one or two conditions.
FREIGHT_CATALOG = """
[{"name": "book_freight", "parameters": {"type": "object",
   "properties": {"mode": {"type": "string", "enum": ["air", "sea"]}, "ports": {"type": "array"}, "box": {"type": "string"}},
   "allOf": [
     {"if": {"properties": {"mode": {"const": "sea"}}},
      "then": {"properties": {"ports": {"type": "array", "items": {"enum": ["kobe", "oslo"]}}}}},
     {"if": {"properties": {"mode": {"const": "air"}}},
      "then": {"properties": {"ports": {"anyOf": [{"items": {"enum": ["lima"]}}, {"type": "null"}]}}}},
     {"if": {"properties": {"mode": {"const": "sea"}, "class": {"const": "1-URGENT"}}},
      "then": {"properties": {"box": {"enum": ["b0", "b1"]}}}}
   ]}},
 {"name": "quote_freight", "parameters": {"type": "object",
   "properties": {"mode": {"type": "string", "enum": ["air", "sea", "road"]}}}}]
"""


def fixture_catalog(spark: SparkSession):
    docs = catalog_documents(spark, text=FIXTURE_CATALOG)
    return tools_dim(docs), tool_params_dim(docs)
