"""Reading observations, requests and stored forecasts; writing results."""
