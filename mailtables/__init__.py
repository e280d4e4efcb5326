"""Support-mail tables on Spark: cleaning, translation, analysis and storage as DataFrame jobs."""
