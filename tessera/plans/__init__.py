"""Named query plans (``queries()`` / ``oracle_sql()`` in __spark_entry__)."""
