"""Column functions: text, salary, requirements, skills, ranking."""
