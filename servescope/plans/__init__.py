"""Registered queries: adapters from the given tables, operator calls, and their oracle SQL.

Every query runs over its whole tables. Conditions on ids in the adapters plant faults (a lost line,
a changed hash, a missing side of a comparison), so that each report has something to find; none
thins a table to make a check cheaper.
"""
