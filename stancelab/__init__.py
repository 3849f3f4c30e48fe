"""stancelab: prompt-audit analytics expressed as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` built from the public
PySpark API.  Column builders live in :mod:`stancelab.functions`, table-level
operators in :mod:`stancelab.operators`, readers/writers in
:mod:`stancelab.sources`, end-to-end plans in :mod:`stancelab.plans` and the
incremental variant of the effect estimate in :mod:`stancelab.streaming`.
"""

__version__ = "0.1.0"
