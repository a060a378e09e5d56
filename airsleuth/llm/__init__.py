"""Operators of a training-data pipeline; nothing else in the library imports them.

``queries.QUERIES`` has a query for each operator, ``queries.ORACLES`` the SQL of
those that SQL can express.
"""
