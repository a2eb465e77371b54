"""Weftline: web-graph analytics and text retrieval on Spark DataFrames.

sources    tables, stores behind URIs, fetched pages, shared scratch tables
functions  column functions: URLs, HTML, networks, text
operators  link graph, crawl, vertex programs, PageRank, text index, ranges, dataflow
streaming  periodic services over Structured Streaming
plans      the registered queries and the SQL that checks them
"""
