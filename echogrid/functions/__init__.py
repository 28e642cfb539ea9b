"""Column functions: complex algebra, radiometry, ionosphere, masks, geodesy."""
