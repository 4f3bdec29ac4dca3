"""estatelens: DataFrame operators for analysing estates of data-pipeline code on Spark."""
