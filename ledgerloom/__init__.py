"""Evidence-to-risk analytics and corpus preparation on PySpark."""
