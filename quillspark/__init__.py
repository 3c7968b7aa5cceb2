"""Retrieval and conversation analytics as Spark DataFrame jobs.

``functions``  column expressions (text, tokens, JSON, arrays, vectors)
``operators``  DataFrame -> DataFrame transforms
``sources``    declared schemas, readers and sinks
``plans``      the registered queries with their oracle SQL
``streaming``  Structured Streaming forms of the stateful operators
"""
