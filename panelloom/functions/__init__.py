"""Column -> Column helpers; everything here stays inside Catalyst expressions."""
