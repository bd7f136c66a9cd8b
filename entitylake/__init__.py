"""entitylake: entity extraction, linking and retrieval as Spark DataFrame jobs.

Every public function takes and returns Spark ``DataFrame`` or ``Column``
objects.  There are no Python UDFs: all work stays in Spark's own expressions.
"""
