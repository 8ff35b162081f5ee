"""Steps of fitting, enumerating, applying and comparing trees."""
