"""Trees to text: a generic print form, the modelling language, JuMP and LaTeX."""
