"""Transaction-risk analytics on Spark DataFrames.

Layers, lowest first:

* ``functions`` - column expressions (cleaning, digits, scores)
* ``sources``   - scans, reference tables, sinks, the star-schema line view
* ``operators`` - one DataFrame-to-DataFrame function per operator
* ``plans``     - the end-to-end reports built from the operators
* ``catalog``   - named queries and the SQL each one is checked against
"""

from cargoscope.config import AnomalyConfig, CaseConfig, RiskConfig

__all__ = ["AnomalyConfig", "CaseConfig", "RiskConfig"]
