"""No streaming operator is in scope.

A stream of labelled examples is used through ``foreachBatch``: each
micro-batch is a plain DataFrame and can be handed to
:class:`gradloom.operators.batches.BatchCycle` or to any objective in
:mod:`gradloom.plans.objectives`.
"""
