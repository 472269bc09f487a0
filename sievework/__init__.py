"""sievework: DataFrame operators for building, checking and scoring labelled text collections on Spark."""
