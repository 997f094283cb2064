"""Training-data operators: one module per operator, plain DataFrame in and out.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and the SQL that the entry file adds when the subpackage is present.
"""
