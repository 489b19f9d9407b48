"""textloom: text-corpus preparation as Spark DataFrame operators.

Tables in, tables out: every operator is a ``DataFrame -> DataFrame`` function
or a ``Column`` expression, so Catalyst plans the work and Spark shuffles it.
"""
