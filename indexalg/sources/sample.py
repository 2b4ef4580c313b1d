"""A small model of our own, used by examples, queries and tests."""

SUPPLY = """\
* Supply of nations over years
$ontext
A text block; nothing in it counts; parameters none;
$offtext
sets
  r   nations
  y   years
  mv(r,y)  nation and year pairs with enough volume
;
alias (r, rp);
parameters
  cost(r,y)   revenue of a nation in a year
  len(y)      weight of a year
;
positive variables
  vFlow(r,y)  flow
;
variables vTotal total;
equations
  eqTotal         total weighted cost
  eqCap(r,y)      capacity
  eqShare(r,y)    share of the total
;
eqTotal.. vTotal =e= sum((r,y)$mv(r,y), cost(r,y) * len(y));
eqCap(r,y)$mv(r,y)..
  vFlow(r,y) =l= cost(r,y) + len(y)$(ord(y) > 1);
eqShare(r,y)$mv(r,y).. vFlow(r,y) - cost(r,y) - len(y) =g= -(vTotal / (1 + card(y)));
"""
