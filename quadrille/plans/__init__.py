"""From questions to operators: intents, steps, reports and the engine."""
