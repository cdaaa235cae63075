"""Named query plans over the test tables, with their oracle SQL."""
