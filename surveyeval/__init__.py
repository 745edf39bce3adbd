"""surveyeval: Spark jobs for evaluating predicted survey answers at scale."""
