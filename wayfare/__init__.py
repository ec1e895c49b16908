"""wayfare — digital-journey and propensity analytics as Spark DataFrame operators.

Every operator takes DataFrames (plus plain parameters or ``Column``
predicates) and returns a lazy DataFrame; nothing is collected to the
driver.  Sub-packages:

* ``sources``    – readers/adapters producing the flat event view and CRM tables
* ``functions``  – pure ``Column`` builders (parameter extraction, event
                   vocabulary, multi-format dates, bucketing)
* ``operators``  – the analyses (sessions, paths, funnels, experiments,
                   identity linking, audiences, propensity)
* ``plans``      – the named query registry used by ``__spark_entry__``
* ``streaming``  – Structured Streaming variants of the stateless steps
"""

__version__ = "0.1.0"
